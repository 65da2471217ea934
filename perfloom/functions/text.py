"""Column functions on names, summaries, comments and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a change as one about performance. The first list is matched against lowered text.
PERFORMANCE_WORDS = [
    "performance", "speedup", "speeds up", "speed-up", "speed up", "faster", "memory", "optimize", "optimization", "profiling", "accelerate", "fast", "runtime", "efficiency", "benchmark",
    "latency", "throughput", "multithreading", "parallel", "concurrency", "concurrent", "profiling", "CPU usage", "memory usage", "resource usage", "cache", "caching", "timeit", "asv",
]
VERBATIM_WORDS = ["PERF", "OPTIM"]
# Keywords that close an issue.
CLOSING_WORDS = ["close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved"]


def lines(text: Column) -> Column:
    """The lines of a text, without the empty one behind a last line break."""
    parts = F.split(text, "\n")
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def summary_value(text: Column, line: int) -> Column:
    """The number behind the colon of a summary's line, from 1."""
    return F.trim(F.get(F.split(F.get(F.split(text, "\n"), F.lit(line - 1)), ":", 2), F.lit(1))).try_cast("double")


def between_tags(text: Column, start: str, end: str) -> Column:
    """What stands between the first `start` and the first `end` behind it; null if either is missing."""
    a = F.instr(text, start)
    rest = F.substring(text, a + len(start), F.length(text))
    b = F.instr(rest, end)
    return F.when((a > 0) & (b > 0), F.substring(rest, F.lit(1), b - 1))


def workload_numbers(output: Column, start: str = "PERF_START:", end: str = "PERF_END:") -> Column:
    """struct<mean, sd> from a workload's output: the first Mean and Std Dev between the tags, on lines that a shell trace did not write."""
    body = F.array_join(F.filter(F.split(between_tags(output, start, end), "\n"), lambda x: ~x.startswith("+")), "\n")
    number = r"\s*([-+0-9.eE]+)"
    return F.struct(F.regexp_extract(body, "Mean:" + number, 1).try_cast("double").alias("mean"), F.regexp_extract(body, "Std Dev:" + number, 1).try_cast("double").alias("sd"))


def without_comments(text: Column) -> Column:
    """Without HTML comments, over line breaks too."""
    return F.regexp_replace(text, r"(?s)<!--.*?-->", "")


def contains_any(text: Column, words: list[str]) -> Column:
    """True if the text has any of `words`. The one-element array binds the text, so that it is computed once and not for each word."""

    def any_of(x: Column) -> Column:
        out = F.lit(False)
        for w in dict.fromkeys(words):
            out = out | F.contains(x, F.lit(w))
        return out

    return F.coalesce(F.exists(F.array(text), any_of), F.lit(False))


def about_performance(*texts: Column) -> Column:
    """True if any text has a performance word, in lower case outside comments, or a verbatim one."""
    out = F.lit(False)
    for t in texts:
        t = F.coalesce(t, F.lit(""))
        out = out | contains_any(without_comments(F.lower(t)), PERFORMANCE_WORDS) | contains_any(t, VERBATIM_WORDS)
    return out


def mentions(text: Column, words: list[str] = PERFORMANCE_WORDS) -> Column:
    """True if the text, in lower case and without comments, has one of `words`; null counts as empty."""
    return contains_any(without_comments(F.lower(F.coalesce(text, F.lit("")))), words)


def keyword_hits(text: Column, words: list[str]) -> Column:
    """Those of `words` that the lowered text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def label_contains(labels: Column, values: list[str]) -> Column:
    """True if any label's name, lowered, contains any of `values`."""
    return F.coalesce(F.exists(labels, lambda x: contains_any(F.lower(x["name"]), values)), F.lit(False))


def issue_references(text: Column, commits: Column | None = None) -> Column:
    """The numbers of issues that a text says it closes."""
    body = without_comments(F.concat_ws("\n", text, *([commits] if commits is not None else [])))
    return F.array_distinct(F.regexp_extract_all(body, F.lit(rf"(?i)(?<!\w)(?:{'|'.join(CLOSING_WORDS)})\s+#(\d+)"), F.lit(1)))


def code_blocks(text: Column) -> Column:
    """The bodies of fenced blocks, but those of suggestions."""
    return F.regexp_extract_all(text, F.lit(r"(?ms)^```(?!suggestion)(?:\w+)?\s*\n(.*?)(?=^```)\n?```"), F.lit(1))


def first_code_block(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)```[^\n`]*\n(.*?)```", 1)


def json_answer(text: Column, schema: str, fallback: Column) -> Column:
    """The outermost {...} of an answer, read by `schema`; `fallback` where there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.from_json(F.when(found != "", found), schema), fallback)


def without_colours(text: Column) -> Column:
    """Without terminal escapes."""
    return F.regexp_replace(text, "\u001b(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])", "")


def id_parts(instance_id: Column) -> Column:
    """struct<owner, repo, number> of owner__repo-number; the number stands behind the last dash."""
    pattern = r"^(.*?)__(.*)-([0-9]+)$"
    return F.struct(*[F.regexp_extract(instance_id, pattern, i + 1).alias(n) for i, n in enumerate(("owner", "repo", "number"))])


def pull_url(instance_id: Column, host: str) -> Column:
    p = id_parts(instance_id)
    return F.concat_ws("/", F.lit(host), p["owner"], p["repo"], F.lit("pull"), p["number"])


def repo_of_log(path: Column) -> Column:
    """owner/repo from a log's path .../owner__repo-number/..."""
    return F.concat_ws("/", F.regexp_extract(path, r"([^/]+)__([^/]+)-[0-9]+/", 1), F.regexp_extract(path, r"([^/]+)__([^/]+)-[0-9]+/", 2))


def model_folder(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("__"))


def major_minor(version: Column) -> Column:
    """The first two parts of a version, digits only."""
    return F.array_join(F.transform(F.slice(F.split(version, r"\."), 1, 2), lambda x: F.regexp_replace(x, "[^0-9]", "")), ".")


def version_in(text: Column, patterns: list[str]) -> Column:
    """The first capture of the first of `patterns` that matches, outside docstrings."""
    bare = F.regexp_replace(text, r'(?s)""".*?"""', "")
    return F.coalesce(*[F.nullif(F.regexp_extract(bare, p, 1), F.lit("")) for p in patterns])


def release_date(text: Column) -> Column:
    """A date written as `Jan 5, 2020`, `January 5, 2020`, `January 2020` or `2020-01-05`; null for others."""
    month = F.regexp_replace(F.trim(text), r"^([A-Za-z]{3})[a-z]*\.?\s+", "$1 ")
    of = lambda fmt: F.try_to_timestamp(month, F.lit(fmt)).cast("date")
    return F.coalesce(of("MMM d, yyyy"), of("MMM yyyy"), F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd")).cast("date"))


def iso_from_millis(x: Column) -> Column:
    """Epoch milliseconds as ISO text; what isn't a whole number stays."""
    n = x.try_cast("long")
    return F.coalesce(F.date_format(F.timestamp_millis(n), "yyyy-MM-dd'T'HH:mm:ss'Z'"), x.cast("string"))


def tracker_time(text: Column) -> Column:
    """A tracker's time in one of three formats."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")])


def script_key(scripts: Column) -> Column:
    """A short hash of a list of script lines."""
    return F.left(F.sha2(F.array_join(scripts, "\n"), 256), F.lit(22))


def cpu_list(text: Column) -> Column:
    """[0, 1, 2, 3, 8] of `0-3,8`."""
    ends = lambda x: F.transform(F.split(x, "-"), lambda y: F.trim(y).cast("int"))
    return F.flatten(F.transform(F.split(text, ","), lambda x: F.sequence(ends(x)[0], F.element_at(ends(x), -1))))


def module_names(path: Column) -> Column:
    """The dotted names under which a path's module may be imported: every tail of its parts."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"/__init__\.py$", ""), r"\.py$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def truth(text: Column) -> Column:
    """True or False of the usual words; raises for others."""
    low = F.lower(text)
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), text)).cast("boolean"))


def starts_with_label(text: Column, labels: dict[str, str]) -> Column:
    """The label of the first prefix that fits, else the text."""
    out = text
    for prefix, label in reversed(list(labels.items())):
        out = F.when(text.startswith(prefix), F.lit(label)).otherwise(out)
    return out


def plain_html(text: Column) -> Column:
    """Text of an HTML fragment: comments, scripts and tags taken out, a few references decoded, white space joined."""
    out = without_comments(text)
    for pattern, to in ((r"(?is)<(script|style)[^>]*>.*?</\1>", " "), (r"<[^>]*>", " "), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def wall_seconds(log: Column) -> Column:
    """The wall time that a log reports."""
    return F.regexp_extract(log, r"(?i)(?:wall[ _]time|elapsed)\D*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def case_names(text: Column) -> Column:
    """Names of [case ...] headers joined by ` or `."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"\[case ([^\]]+)\]"), F.lit(1)), " or ")


def is_test_file(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1)).rlike(r"^(test.*\.py|.*_test\.py)$")


def requirement_lines(text: Column, drop: list[str], replace: dict[str, str]) -> Column:
    """A requirements file without lines that begin with one of `drop`, and with others replaced as a whole."""
    kept = F.filter(lines(text), lambda x: ~contains_prefix(x, drop))
    return F.array_join(F.transform(kept, lambda x: _replaced(x, replace)), "\n")


def contains_prefix(x: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | x.startswith(p)
    return out


def _replaced(x: Column, replace: dict[str, str]) -> Column:
    out = x
    for a, b in replace.items():
        out = F.when(x == a, F.lit(b)).otherwise(out)
    return out
