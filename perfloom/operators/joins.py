"""Joins with the semantics that records need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.functions.text import stripped
from perfloom.operators.graph import checkpoints
from perfloom.operators.ranges import contained, overlapping  # noqa: F401


def keep(rows: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(ids, key, "left_semi")


def drop(rows: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(ids, key, "left_anti")


def missing(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids of `wanted` that `known` lacks."""
    return wanted.select(key).distinct().join(known, key, "left_anti")


def require(wanted: DataFrame, known: DataFrame, key: str, what: str = "ids") -> DataFrame:
    """`wanted`, after a check that `known` has all of its ids."""
    lost = [r[0] for r in missing(wanted, known, key).orderBy(key).limit(20).collect()]
    if lost:
        raise ValueError(f"unknown {what}: {', '.join(map(str, lost))}")
    return wanted


def as_of(left: DataFrame, right: DataFrame, time: str, released: str, value: str, by: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """`left` with the `value` of the newest row of `right` strictly before its time; null where there is none.

    Of several releases at one time the one with the largest `tie` counts (`value` if none is named), and null values
    don't count. Rows without a time have none before, and releases without one are before nothing.

    Only the different times of each key are looked up: times and releases go into one stream, dealt out by ranges of key
    and time. Each part carries its last value forward, and then takes the last value of the parts before it; these are
    one row for each part and key. So a key that has most rows, or none at all (no `by`), is spread over all tasks.
    """
    by = by or []
    tie = tie or value
    checkpoints(left.sparkSession)
    times = left.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("_t")).distinct()
    best = F.max_by(F.struct(F.col(value).alias("v")), F.struct(F.col(tie).isNotNull(), F.col(tie), F.col(value)))
    news = right.where(F.col(released).isNotNull() & F.col(value).isNotNull()).groupBy(*by, F.col(released).alias("_t")).agg(best.alias("_v"))
    # A time's own release comes behind the time itself.
    both = times.withColumn("_side", F.lit(0)).withColumn("_v", F.lit(None).cast(news.schema["_v"].dataType)).unionByName(news.withColumn("_side", F.lit(1)).select(*by, "_t", "_side", "_v"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges come from a sample, so they are settled before they are read twice.
    rows = both.repartitionByRange(parts, *by, "_t").withColumn("_p", F.spark_partition_id()).checkpoint()
    within = Window.partitionBy(*by, "_p").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("_side = 1").groupBy(*by, "_p").agg(F.max_by("_v", "_t").alias("_end")).unionByName(rows.select(*by, "_p").distinct().withColumn("_end", F.lit(None).cast(news.schema["_v"].dataType)))
    ends = ends.groupBy(*by, "_p").agg(F.first("_end", ignorenulls=True).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*[F.col(k).alias(f"_b{k}") for k in by], F.col("_p").alias("_q"), F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    found = rows.withColumn("_last", F.last("_v", ignorenulls=True).over(within)).where("_side = 0")
    found = found.join(before, [F.col("_p") == F.col("_q")] + [F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in by])
    found = found.select(*[F.col(k).alias(f"_k{k}") for k in by], F.col("_t").alias("_time"), F.coalesce("_last", "_before")["v"].alias("_value"))
    kept = left.drop(value) if value in left.columns else left
    on = [F.col(time) == F.col("_time")] + [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in by]
    return kept.join(found, on, "left").select(*[F.col(c) for c in kept.columns], F.col("_value").alias(value))


def first_by(rows: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order.

    Where the order is by columns, ascending, the rows of a key are merged before the shuffle; other orders rank them.
    """
    keys = [key] if isinstance(key, str) else key
    if all(isinstance(o, str) for o in order):
        least = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
        return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(least).select("_row.*")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def updated(rows: DataFrame, other: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """`rows` (first of each key) with `columns` taken from `other` (first of each key) where that has a value."""
    new = first_by(other, key, order).select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = first_by(rows, key, order).join(new, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def overridden(rows: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """`column` replaced by that of `other`; empty where that is absent or `nan`."""
    new = other.select(key, F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.when(F.coalesce("_new", F.lit("nan")) == "nan", "").otherwise(F.col("_new"))).drop("_new")


def approved(rows: DataFrame, sheet: DataFrame, key: str, column: str = "workload", statuses: tuple[str, ...] = ("APPROVED", "NEEDS_ANNOTATE")) -> DataFrame:
    """Rows with the sheet's text, where its status is one of `statuses` and the text isn't empty."""
    ok = sheet.where(F.col("status").isin(*statuses) & (stripped(F.col(column)) != "")).select(key, column)
    return rows.drop(column).join(ok, key)


def deltas(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, delta = before - after over the keys of either side; a missing side is 0."""
    a, b = before.select(*key, F.col(value).alias("_a")), after.select(*key, F.col(value).alias("_b"))
    return a.join(b, key, "full_outer").select(*key, (F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("delta"))


def mismatches(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys of either side whose values differ, with both; a null value is a value of its own."""
    a, b = left.select(*key, F.struct(value).alias("_a")), right.select(*key, F.struct(value).alias("_b"))
    return a.join(b, key, "full_outer").where("not (_a <=> _b)").select(*key, F.col(f"_a.{value}").alias("left_value"), F.col(f"_b.{value}").alias("right_value"))


def covering_tests(coverage: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tests that run a wanted line: coverage (test, file, line) against (file, line)."""
    return coverage.join(wanted.select("file", "line").distinct(), ["file", "line"], "left_semi").select("test").distinct()


def same_path(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of paths with the same last part, or of which one ends with the other, at a slash or not; empty ones match nothing.

    Paths that end with each other have the same last part, unless the shorter one is a last part's own tail: so the
    join is on last parts and on tails, and no path meets all others.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"/(\./)*/*", "/"), r"^\./|(?<=.)/$", "")
    ids = lambda df, c, n: df.where(F.trim(c) != "").select("*", plain(F.col(c)).alias(f"_{n}"), F.element_at(F.split(plain(F.col(c)), "/"), -1).alias(f"_{n}_last"))
    x, y = ids(a, left, "x"), ids(b, right, "y")
    tails = lambda n: F.explode(F.transform(F.sequence(F.lit(2), F.length(f"_{n}_last")), lambda i: F.substring(f"_{n}_last", i, F.length(f"_{n}_last")))).alias("_tail")
    same = x.join(y, F.col("_x_last") == F.col("_y_last"))
    bare = lambda df, n: df.where(~F.contains(f"_{n}", F.lit("/"))).withColumn("_tail", F.col(f"_{n}"))
    long = lambda df, n: df.where(F.length(f"_{n}_last") > 1).select("*", tails(n))
    over = long(x, "x").join(bare(y, "y"), "_tail").drop("_tail")
    under = bare(x, "x").join(long(y, "y"), "_tail").drop("_tail")
    return same.unionByName(over).unionByName(under).drop("_x", "_y", "_x_last", "_y_last")


def among_paths(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of `a` whose path matches any of `b`'s, as `same_path` matches them.

    Only different names meet: the last parts of both sides, and, for paths without a slash, the ends of the other side's
    last parts. Ends are cut at the lengths that such names have, so a last part gives no more of them than there are
    lengths. However many paths end in one name, that name is one row.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"/(\./)*/*", "/"), r"^\./|(?<=.)/$", "")
    of = lambda df, c: df.where(F.trim(c) != "").select(plain(F.col(c)).alias("path"), F.element_at(F.split(plain(F.col(c)), "/"), -1).alias("name")).distinct()
    bare = lambda paths: paths.where("path = name").select("name").distinct()

    def ends(names: DataFrame, shorter: DataFrame) -> DataFrame:
        """name, end: ends of `names` with the length of one of `shorter`; one row with the lengths goes to every task."""
        lengths = shorter.agg(F.collect_set(F.length("name")).alias("_n"))
        cut = names.crossJoin(F.broadcast(lengths)).withColumn("_m", F.explode("_n")).where(F.col("_m") < F.length("name"))
        return cut.select("name", F.expr("right(name, _m)").alias("end"))

    x, y = of(a, left), of(b, right)
    x_names, y_names = x.select("name").distinct(), y.select("name").distinct()
    same = x_names.join(y_names, "name", "left_semi")
    longer = ends(x_names, bare(y)).join(bare(y).withColumnRenamed("name", "end"), "end", "left_semi").select("name")
    # Names of `a` without a slash that are ends of names of `b`.
    inner = ends(y_names, bare(x)).select(F.col("end").alias("name")).distinct()
    whole = same.union(longer).distinct().select(F.col("name").alias("_hit"))
    short = bare(x).join(inner, "name", "left_semi").select(F.col("name").alias("_short"))
    rows = a.withColumns({"_path": plain(F.col(left)), "_name": F.element_at(F.split(plain(F.col(left)), "/"), -1)}).where(F.trim(left) != "")
    by_name = rows.join(whole, F.col("_name") == F.col("_hit"), "left_semi")
    by_path = rows.join(whole, F.col("_name") == F.col("_hit"), "left_anti").join(short, F.col("_path") == F.col("_short"), "left_semi")
    return by_name.unionByName(by_path).drop("_path", "_name")


def paired(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of two lists paired by their places within `keys`: columns of `a`, those of `b` as `other`, and `place` from 0.

    Where both sides have an id, join on that instead; a place says nothing once a row is missing.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    at = lambda df: df.withColumn("place", F.row_number().over(w) - 1)
    other = at(b).select(*keys, "place", F.struct(*b.columns).alias("other"))
    return at(a).join(other, [*keys, "place"])


def relevant_tests(covering: DataFrame, files: DataFrame, named: Column) -> DataFrame:
    """Tests that coverage found, and files that are tests by their name: a set."""
    return covering.select("test").union(files.where(named).select(F.col(files.columns[0]).alias("test"))).distinct()


def first_found(wanted: DataFrame, held: DataFrame, key: str, paths: list[str]) -> DataFrame:
    """key, path, text: of files staged as (key, path, text), the first of `paths` that a key has; null without any."""
    order = F.array_position(F.array(*[F.lit(p) for p in paths]), F.col("path"))
    best = held.where(order > 0).groupBy(key).agg(F.min_by(F.struct("path", "text"), order).alias("_f"))
    return wanted.select(key).join(best, key, "left").select(key, "_f.path", "_f.text")


def not_imported(modules: DataFrame, imports: DataFrame, name: str, imported: str) -> DataFrame:
    """Modules that no import names by any of their dotted tails."""
    tails = modules.withColumn("_tail", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(name, r"\."))), lambda i: F.array_join(F.slice(F.split(name, r"\."), i, F.size(F.split(name, r"\."))), "."))))
    hit = tails.join(imports.select(F.col(imported).alias("_tail")).distinct(), "_tail", "left_semi").select(name).distinct()
    return modules.join(hit, name, "left_anti")


def in_all_runs(runs: DataFrame, key: str, run: str, count: int) -> DataFrame:
    """Keys that every one of `count` runs has."""
    return runs.groupBy(key).agg(F.count_distinct(run).alias("_n")).where(F.col("_n") == count).select(key)


def rerun_or_first(first: DataFrame, rerun: DataFrame, key: str) -> DataFrame:
    """The rows of the rerun for keys that it has, else the first ones."""
    return rerun.unionByName(first.join(rerun, key, "left_anti"))


def take_while(rows: DataFrame, by: list[str], order: list[str], ok: Column) -> DataFrame:
    """Rows of each group up to the first that isn't `ok`."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_late", F.max((~F.coalesce(ok, F.lit(False))).cast("int")).over(w)).where("_late = 0").drop("_late")


def without_matches(rows: DataFrame, patterns: list[str], column: str) -> DataFrame:
    """Rows whose text has none of `patterns` as a substring."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(column, F.lit(p))
    return rows.where(~F.coalesce(hit, F.lit(False)))


def mapped_status(tests: Column, status: Column) -> Column:
    """The number of `tests` that pass by substring in a map test -> status; absent ones fail."""
    return F.size(F.filter(tests, lambda t: F.contains(F.coalesce(F.try_element_at(status, t), F.lit("")), F.lit("PASS"))))
