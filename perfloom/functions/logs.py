"""Test logs: every format turns a line into at most a few (test, status) findings; the last finding of a test counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.functions.text import without_colours

# Statuses and the markers of evaluation logs.
STATUSES = ["FAILED", "PASSED", "SKIPPED", "ERROR", "XFAIL"]
FAILURE_MARKERS = [">>>>> Patch Apply Failed", ">>>>> Reset Failed", ">>>>> Tests Errored", ">>>>> Tests Timed Out", "Failed to reset task environment"]
APPLIED, APPLIED_PRED = "applied patch", "Applied Patch (pred)"

_ANY = "|".join(STATUSES)


def _found(name: Column, status: Column, when: Column) -> Column:
    ok = F.coalesce(when & (name != "") & (status != ""), F.lit(False))
    return F.when(ok, F.array(F.struct(name.alias("test"), status.alias("status")))).otherwise(F.array().cast("array<struct<test:string,status:string>>"))


def _starts(line: Column) -> Column:
    return line.rlike(f"^(?:{_ANY})")


def _softened(line: Column) -> Column:
    """A failure's ` - ` in front of its message counts as a space."""
    return F.when(line.startswith("FAILED"), F.replace(line, F.lit(" - "), F.lit(" "))).otherwise(line)


def _word(line: Column, i: int) -> Column:
    return F.coalesce(F.get(F.split(F.trim(line), r"\s+"), F.lit(i)), F.lit(""))


def _rest(line: Column) -> Column:
    return F.regexp_extract(line, r"^\s*\S+\s+(.*)$", 1)


def name_without_trailer(text: Column) -> Column:
    """The test's name: the first word or, with a bracket, up to the bracket that closes the first one."""
    chars = F.split(F.regexp_extract(text, r"^[^\[]*(\[.*)$", 1), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), F.concat(acc["out"], c).alias("out"), ((c == "]") & (depth == 0)).alias("done")))

    nested = F.aggregate(chars, start, step, lambda acc: acc["out"])
    simple = F.regexp_extract(text, r"^([^\[]*\[[^\[\]]*\])", 1)
    return F.when(~F.contains(text, F.lit("[")), _word(text, 0)).when(simple != "", simple).otherwise(F.concat(F.regexp_extract(text, r"^([^\[]*)", 1), nested))


def pytest(line: Column) -> Column:
    soft = _softened(line)
    return _found(name_without_trailer(_rest(soft)), _word(soft, 0), _starts(line) & (_rest(soft) != ""))


def pytest_options(line: Column) -> Column:
    """A bracketed option that is a path counts by its last part."""
    soft = _softened(line)
    name = _word(soft, 1)
    option = F.regexp_extract(name, r"^.*?\[(.*)\]", 1)
    path = option.startswith("/") & ~option.startswith("//") & ~F.contains(option, F.lit("*"))
    short = F.concat(F.regexp_extract(name, r"^(.*?)\[", 1), F.lit("["), F.when(path, F.concat(F.lit("/"), F.element_at(F.split(option, "/"), -1))).otherwise(option), F.lit("]"))
    return _found(F.when(name.rlike(r"^.*?\[.*\]"), short).otherwise(name), _word(soft, 0), _starts(line))


def pytest_v2(line: Column, clean: bool = False) -> Column:
    """The status stands first or last. With `clean` the name loses what trails it."""
    bare = without_colours(line)
    soft = _softened(bare)
    name = name_without_trailer(_rest(soft)) if clean else _rest(soft)
    last = bare.rlike(f"(?:{_ANY})$") & ~_starts(bare)
    return F.concat(_found(name, _word(soft, 0), _starts(bare)), _found(F.regexp_extract(bare, r"^(.*\S)\s+\S+$", 1), F.regexp_extract(bare, r"(\S+)$", 1), last))


def seaborn(line: Column) -> Column:
    infix = F.contains(line, F.lit(" PASSED ")) & ~line.startswith("FAILED")
    return F.concat(
        _found(_word(line, 1), F.lit("FAILED"), line.startswith("FAILED")),
        _found(_word(line, 0), F.lit("PASSED"), infix & (_word(line, 1) == "PASSED")),
        _found(_word(line, 1), F.lit("PASSED"), line.startswith("PASSED") & ~infix),
    )


def matplotlib(line: Column) -> Column:
    soft = _softened(F.replace(F.replace(line, F.lit("MouseButton.LEFT"), F.lit("1")), F.lit("MouseButton.RIGHT"), F.lit("3")))
    return _found(_word(soft, 1), _word(soft, 0), _starts(soft))


def pydantic(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"\[\d+m", ""), "[\u0001-\u001f]", ""), r"FAILED\s*\[.*?\]", "FAILED")
    soft = _softened(bare)
    return F.concat(_found(_word(soft, 1), _word(soft, 0), _starts(bare)), _found(_word(bare, 0), _word(bare, 1), bare.rlike(f"(?:{_ANY})$") & ~_starts(bare)))


FORMATS: dict[str, Callable[[Column], Column]] = {"pytest": pytest, "pytest_options": pytest_options, "pytest_v2": pytest_v2, "seaborn": seaborn, "matplotlib": matplotlib, "pydantic": pydantic}
#: The format of a repository's logs.
REPOSITORIES = dict.fromkeys(("astroid", "flask", "marshmallow", "pvlib", "pyvista", "sqlfluff", "xarray", "dask"), "pytest")
REPOSITORIES |= dict.fromkeys(("pydicom", "requests", "pylint"), "pytest_options") | dict.fromkeys(("astropy", "scikit-learn", "sphinx", "pandas"), "pytest_v2")
REPOSITORIES |= {"seaborn": "seaborn", "matplotlib": "matplotlib", "pydantic": "pydantic", "numpy": "unique_prefix", "scipy": "unique_prefix", "django": "django", "sympy": "sympy"}


def log_lines(logs: DataFrame, key: str, log: str = "log") -> DataFrame:
    return logs.select(key, F.posexplode(F.split(log, "\r?\n")).alias("no", "line"))


def _last_of(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key, "test").agg(F.max_by("status", F.struct("no", "i")).alias("status"))


def parse(logs: DataFrame, key: str, format: str, log: str = "log") -> DataFrame:
    """key, test, status of logs in one format; the last line about a test counts."""
    if format == "unique_prefix":
        return unique_prefixes(parse(logs, key, "pytest", log), key)
    if format == "django":
        return django(logs, key, log)
    if format == "sympy":
        return sympy(logs, key, log)
    rows = log_lines(logs, key, log).select(key, "no", F.posexplode(FORMATS[format](F.col("line"))).alias("i", "x"))
    return _last_of(rows.select(key, "no", "i", "x.*"), key)


def parse_all(logs: DataFrame, key: str, repo: str, log: str = "log") -> DataFrame:
    """As `parse`, the format chosen by the repository's name in column `repo`."""
    out = None
    for name in sorted(set(REPOSITORIES.values())):
        repos = [r for r, f in REPOSITORIES.items() if f == name]
        part = parse(logs.where(F.lower(repo).isin(repos)), key, name, log)
        out = part if out is None else out.unionByName(part)
    return out


def unique_prefixes(found: DataFrame, key: str) -> DataFrame:
    """Tests by their name up to the bracket, where only one test has that; others are dropped."""
    prefix = F.regexp_extract("test", r"^([^\[]*)", 1)
    return found.withColumn("prefix", prefix).groupBy(key, "prefix").agg(F.count("*").alias("n"), F.max("status").alias("status")).where("n = 1").selectExpr(key, "prefix test", "status")


# What the runners of two projects write, here and in `sympy` below.
def django(logs: DataFrame, key: str, log: str = "log") -> DataFrame:
    """The runner's lines `name ... ok`, and a lone `ok` that belongs to the last name begun before it."""
    rows = log_lines(logs, key, log).withColumn("line", F.trim("line"))
    line = F.col("line")
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("begun", F.last(F.when(F.contains("line", F.lit(" ... ")), F.substring_index("line", " ... ", 1)), ignorenulls=True).over(w))
    passed = F.regexp_extract("line", r"^(.*) \.\.\.  ?(?:ok|OK)$", 1)
    passed = F.when(passed.startswith("Applying sites.0002_alter_domain_unique...test_no_migrations"), F.regexp_extract(passed, r"\.\.\.(.*)$", 1)).otherwise(passed)
    at = lambda mark: F.substring_index("line", mark, 1)
    found = F.concat(
        _found(F.lit("--version is equivalent to version"), F.lit("PASSED"), F.contains("line", F.lit("--version is equivalent to version"))),
        _found(passed, F.lit("PASSED"), passed != ""),
        _found(at(" ... skipped"), F.lit("SKIPPED"), F.contains("line", F.lit(" ... skipped"))),
        _found(at(" ... FAIL"), F.lit("FAILED"), line.endswith(" ... FAIL")),
        _found(_word(line, 1), F.lit("FAILED"), line.startswith("FAIL:")),
        _found(at(" ... ERROR"), F.lit("ERROR"), line.endswith(" ... ERROR")),
        _found(_word(line, 1), F.lit("ERROR"), line.startswith("ERROR:")),
        _found(F.col("begun"), F.lit("PASSED"), line.startswith("ok") & F.col("begun").isNotNull()),
    )
    rows = rows.select(key, "no", F.posexplode(found).alias("i", "x")).select(key, "no", "i", "x.*")
    # A long message can stand between a name and its `ok`; such findings come after all lines.
    late = None
    for n, p in enumerate((r"Testing against Django installed in (?:(?s).*?) silenced\)\.\nok$", r"Internal Server Error: /.*/\nok$", r"System check identified no issues \(0 silenced\)\nok$")):
        names = F.regexp_extract_all(F.col(log), F.lit(rf"(?m)^(.*?)\s\.\.\.\s{p}"), F.lit(1))
        part = logs.select(key, F.lit((1 << 31) - 2).alias("no"), F.lit(n).alias("i"), F.explode(names).alias("test"), F.lit("PASSED").alias("status"))
        late = part if late is None else late.unionByName(part)
    return _last_of(rows.unionByName(late), key)


def sympy(logs: DataFrame, key: str, log: str = "log") -> DataFrame:
    """Lines that begin with sympy/ where pytest ran; else headers of failures, then the runner's endings."""
    new = F.contains(log, F.lit("pytest"))
    rows = log_lines(logs.where(new), key, log)
    line = F.col("line")
    modern = rows.select(key, "no", F.posexplode(_found(_word(line, 0), _word(line, 1), F.trim("line").startswith("sympy/") & (_word(line, 2) != ""))).alias("i", "x")).select(key, "no", "i", "x.*")
    old = logs.where(~new)
    head = old.select(key, F.lit(-1).alias("no"), F.lit(0).alias("i"), F.explode(F.regexp_extract_all(F.col(log), F.lit(r"(?:_*) (.*\.py:.*) (?:_*)"), F.lit(1))).alias("test"), F.lit("FAILED").alias("status"))
    rows = log_lines(old, key, log).withColumn("line", F.trim("line")).where("line like 'test\\_%'")
    rows = rows.withColumn("line", F.when(F.col("line").rlike(r"\[(?:FAIL|OK)\]$"), F.trim(F.regexp_extract("line", r"^(.*)\[", 1))).otherwise(F.col("line")))
    line = F.col("line")
    ends = F.concat(*[_found(_word(line, 0), F.lit(s), line.endswith(e)) for e, s in ((" E", "ERROR"), (" F", "FAILED"), (" ok", "PASSED"))])
    rows = rows.select(key, "no", F.posexplode(ends).alias("i", "x")).select(key, "no", "i", "x.*")
    return _last_of(modern.unionByName(head).unionByName(rows), key)


def usable_part(log: Column) -> Column:
    """The part of an evaluation log to parse: null if a failure is marked or no patch was applied, else what follows the last time the prediction was applied."""
    bad = F.lit(False)
    for m in FAILURE_MARKERS:
        bad = bad | F.contains(log, F.lit(m))
    return F.when(~bad & F.contains(F.lower(log), F.lit(APPLIED)), F.substring_index(log, APPLIED_PRED, -1))


def passes(status: Column) -> Column:
    """By grading: present and passed, or failed as expected."""
    return F.coalesce(status.isin("PASSED", "XFAIL"), F.lit(False))


def fails(status: Column) -> Column:
    """By grading: absent, failed or in error. A skipped test neither passes nor fails."""
    return F.coalesce(status.isin("FAILED", "ERROR"), F.lit(True))


def reported(status: Column) -> Column:
    """By substring, as reports read it: PASS, FAIL, SKIP or null."""
    return F.when(F.contains(status, F.lit("PASS")), "PASS").when(F.contains(status, F.lit("FAIL")) | F.contains(status, F.lit("ERROR")), "FAIL").when(F.contains(status, F.lit("SKIP")), "SKIP")


def imports_broken(log: Column) -> Column:
    """True if a line of the log tells of an attribute or import error."""
    return log.rlike(r"(?m)^.*(?:AttributeError|ImportError|ModuleNotFoundError).*$")


def lines_between(log: Column, start: str, end: str) -> Column:
    """Lines strictly between two markers, without those of a shell trace."""
    rows = F.split(log, "\n")
    a, b = F.array_position(rows, start), F.array_position(rows, end)
    return F.when((a > 0) & (b > a), F.filter(F.slice(rows, (a + 1).cast("int"), (b - a - 1).cast("int")), lambda x: ~x.startswith("+"))).otherwise(F.array().cast("array<string>"))


def edit_counts(log: Column, start: str, end: str) -> Column:
    """True if a syntax check's output names a meaningful edit or could not tell."""
    return F.exists(lines_between(log, start, end), lambda x: F.contains(x, F.lit("MEANINGFUL")) | F.contains(x, F.lit("Warning")))
