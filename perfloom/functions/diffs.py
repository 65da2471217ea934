"""Column functions on unified diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.functions.text import lines

# Endings of files that aren't tests, and of source files.
NOT_TESTS = [".json", ".png", "csv", ".txt", ".md", ".jpg", ".jpeg", ".pkl", ".yml", ".yaml", ".toml"]
SOURCES = [".py", ".ini", ".f", ".pyx", ".h", ".build", ".cfg", ".cpp", ".json", ".pyi", ".pxd", ".yaml", ".toml", ".cxx"]


def changed_lines(patch: Column) -> Column:
    """Lines that a diff adds or removes, without file headers."""
    return F.size(F.filter(lines(F.coalesce(patch, F.lit(""))), lambda x: (x.startswith("+") & ~x.startswith("+++")) | (x.startswith("-") & ~x.startswith("---")))).cast("long")


def total_lines(patch: Column) -> Column:
    return F.size(lines(F.coalesce(patch, F.lit("")))).cast("long")


def files(patch: Column) -> Column:
    """New paths of the files of a diff."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^diff --git a/\S+ b/(\S+)"), F.lit(1)))


def old_files(patch: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^--- a/(.*)$"), F.lit(1)))


def tails(paths: Column, parts: int = 2) -> Column:
    """The last parts of each path."""

    def tail(x: Column) -> Column:
        p = F.split(x, "/")
        n = F.least(F.size(p), F.lit(parts))
        return F.array_join(F.slice(p, F.size(p) - n + 1, n), "/")

    return F.array_distinct(F.transform(paths, tail))


def all_files(patch: Column) -> Column:
    """Paths of header lines of any kind, old and new."""
    return F.array_distinct(F.flatten(F.array(files(patch), F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^(?:\+\+\+ b|--- a)/(.*)$"), F.lit(1)))))


def functions(patch: Column) -> Column:
    """Names of the functions that hunks stand in or that added or removed lines define."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(patch, F.lit("")), F.lit(r"(?m)^(?:@@.*@@|[+-])\s*(?:async\s+)?def\s+(\w+)"), F.lit(1)))


def ends_with_any(x: Column, endings: list[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | x.endswith(e)
    return out


def source_files(patch: Column) -> Column:
    return F.filter(files(patch), lambda x: ends_with_any(x, SOURCES))


def test_targets(test_patch: Column, dotted: bool = False) -> Column:
    """Files of a test patch that may hold tests; as dotted modules below tests/ if `dotted`."""
    kept = F.filter(files(test_patch), lambda x: ~ends_with_any(x, NOT_TESTS))
    return F.transform(kept, lambda x: F.replace(F.regexp_replace(F.regexp_replace(x, r"\.py$", ""), "^tests/", ""), F.lit("/"), F.lit("."))) if dotted else kept


def only_documents(paths: Column) -> Column:
    return F.forall(paths, lambda x: x.rlike(r"\.(md|rst)$"))


def any_lock(paths: Column) -> Column:
    return F.exists(paths, lambda x: x.rlike(r"\.lock$"))


def file_diffs(df: DataFrame, patch: str = "patch") -> DataFrame:
    """A row for each file's part of a diff, with `source`, `dest` and `body`."""
    out = df.withColumn("_part", F.explode(F.split(patch, r"(?m)^(?=diff --git )"))).where("_part like 'diff --git %'")
    head = r"^diff --git a/(\S+) b/(\S+)"
    return out.select("*", F.regexp_extract("_part", head, 1).alias("source"), F.regexp_extract("_part", head, 2).alias("dest"), F.col("_part").alias("body")).drop("_part")


def split_tests(df: DataFrame, key: str, patch: str = "patch", words: tuple[str, ...] = ("test", "tests", "e2e", "testing")) -> DataFrame:
    """key, fix_patch, test_patch: a file's part goes to the tests if its path contains one of `words`."""
    parts = file_diffs(df.select(key, patch), patch)
    is_test = F.lit(False)
    for w in words:
        is_test = is_test | F.contains("dest", F.lit(w))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(F.col("dest"), F.col("body"))))), lambda x: x["body"]), "")
    return parts.groupBy(key).agg(joined(~is_test).alias("fix_patch"), joined(is_test).alias("test_patch"))


def diff_lines(df: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """key, file, hunk, pos, kind, line_no, text: the body lines of a diff with their numbers in the new file; and `first` and `last`, those of its hunk.

    A removed line has the number of the line before it; only others advance. Each diff is read within its row, by filters
    and slices over its lines, so nothing is shuffled.
    """
    line = F.transform(F.split(patch, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("text")))
    rows = df.select(key, line.alias("_lines"))
    file = lambda x: F.nullif(F.regexp_extract(x, r"^\+\+\+ (?:b/)?(.*)$", 1), F.lit(""))
    start = lambda x: F.regexp_extract(x, r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)", 1).try_cast("int")
    marks = F.filter("_lines", lambda x: x["text"].startswith("+++ ") | x["text"].startswith("@@ -"))
    marks = F.filter(F.transform(marks, lambda x: F.struct(x["pos"].alias("pos"), file(x["text"]).alias("file"), start(x["text"]).alias("start"))), lambda x: x["file"].isNotNull() | x["start"].isNotNull())
    # The file that each mark stands in is carried along the marks, which are few.
    kind = "struct<pos:int,file:string,start:int>"
    carried = lambda acc, x: F.array_append(acc, F.struct(x["pos"].alias("pos"), F.coalesce(x["file"], F.try_element_at(acc, F.lit(-1))["file"]).alias("file"), x["start"].alias("start")))
    carried_or_first = lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(carried(acc, x))
    rows = rows.select(key, "_lines", F.aggregate(marks, F.array().cast(f"array<{kind}>"), carried_or_first).alias("_marks"))
    hunks = F.filter(F.transform("_marks", lambda x, i: F.struct(i.alias("at"), x.alias("mark"))), lambda x: x["mark"]["start"].isNotNull())
    rows = rows.select(key, "_lines", "_marks", hunks.alias("_hunks"))
    head = r"^(diff --git|index |--- |\+\+\+ |@@|new file|deleted file|similarity|rename|\\)"

    def hunk(x: Column, i: Column) -> Column:
        here, after = x["mark"]["pos"], F.get("_hunks", i + 1)
        body = F.slice("_lines", here + 2, F.coalesce(after["mark"]["pos"], F.size("_lines")) - here - 1)
        other = F.slice("_marks", x["at"] + 2, F.coalesce(after["at"], F.size("_marks")) - x["at"] - 1)
        return F.struct((i + 1).cast("long").alias("hunk"), x["mark"]["start"].cast("long").alias("start"), x["mark"]["file"].alias("file"), other.alias("files"), F.filter(body, lambda y: ~y["text"].rlike(head)).alias("body"))

    rows = rows.select(key, F.explode(F.transform("_hunks", hunk)).alias("_h")).select(key, "_h.*")
    rows = rows.withColumn("body", F.transform("body", lambda y, i: F.struct(y["pos"].alias("pos"), y["text"].alias("text"), i.alias("i"))))
    rows = rows.withColumns({"gone": F.filter("body", lambda y: y["text"].startswith("-")), "stay": F.filter("body", lambda y: ~y["text"].startswith("-"))})
    numbered = lambda c, n: F.transform(c, lambda y, j: F.struct(y["pos"].alias("pos"), y["text"].alias("text"), n(y, j).cast("int").alias("line_no")))
    both = F.concat(numbered("gone", lambda y, j: F.col("start") - 1 + y["i"] - j), numbered("stay", lambda y, j: F.col("start") + j))
    some = F.size("stay") > 0
    ends = F.when(some, F.col("start")).cast("int").alias("first"), F.when(some, F.col("start") - 1 + F.size("stay")).cast("int").alias("last")
    rows = rows.select(key, "file", "files", "hunk", *ends, F.explode(both).alias("_y"))
    kind = F.when(F.col("_y.text").startswith("+"), "+").when(F.col("_y.text").startswith("-"), "-").otherwise(" ")
    later = F.try_element_at(F.filter("files", lambda m: m["pos"] < F.col("_y.pos")), F.lit(-1))["file"]
    return rows.select(key, F.coalesce(F.when(F.size("files") > 0, later), "file").alias("file"), "hunk", "_y.pos", kind.alias("kind"), "_y.line_no", F.substring("_y.text", 2, 1 << 30).alias("text"), "first", "last")


def renumbered(hunks: DataFrame, key: str, file: str = "file") -> DataFrame:
    """Hunks (file, old_start, old_count, new_count) with `new_start` from the changes of those before them in the file."""
    before = Window.partitionBy(key, file).orderBy("old_start").rowsBetween(Window.unboundedPreceding, -1)
    return hunks.withColumn("new_start", F.col("old_start") + F.coalesce(F.sum(F.col("new_count") - F.col("old_count")).over(before), F.lit(0)))


def surviving_neighbours(rows: DataFrame, key: str) -> DataFrame:
    """For removed lines of `diff_lines`, the numbers of the nearest lines before and after that stay.

    Lines that stay are numbered without gaps within a hunk, and a removed line has the number of the one before it: so its
    own number and those of the hunk's first and last line say both.
    """
    before, after = F.when(F.col("line_no") >= F.col("first"), F.col("line_no")), F.when(F.col("line_no") < F.col("last"), F.col("line_no") + 1)
    return rows.where("kind = '-'").select(key, "file", "hunk", "pos", before.alias("before"), after.alias("after"))
