"""Analytics that depend on order: prefix curves, buckets, state carried along lines, spans and greedy choice."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.operators.graph import checkpoints
from perfloom.operators.ranges import smallest_span  # noqa: F401


def range_of(df: DataFrame, x: str) -> Column:
    """The number of the range of x that a row falls into, of as many ranges as a shuffle has partitions.

    The bounds are approximate quantiles, which are all that reaches the driver; ranges need not be of equal size. To find
    them takes a pass over x when the plan is made, as a sort by range would take one too.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    found = df.agg(F.percentile_approx(x, shares, 10_000).alias("b")).first()["b"] or []
    bounds = sorted(set(found))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(x)))


def running_totals(df: DataFrame, x: str, columns: list[str]) -> DataFrame:
    """`df` with each of `columns` replaced by its sum over all rows up to this x, which must be distinct.

    Rows are dealt out by ranges of x and summed within each range; the ranges' own totals, one row for each, are
    summed and added. So no task gets all rows.
    """
    rows = df.withColumn("_p", range_of(df, x))
    within = Window.partitionBy("_p").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_p").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    ranges = ranges.select("_p", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    rows = rows.withColumns({c: F.sum(c).over(within) for c in columns}).join(F.broadcast(ranges), "_p")
    return rows.withColumns({c: F.col(c) + F.col(f"_{c}") for c in columns}).drop("_p", *[f"_{c}" for c in columns])


def dealt(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`df` with `_p`, the number of the range of (by, order) that a row falls into; ranges follow that order.

    Rows of a key, however many, go to as many ranges as they fill; equal ones share one. Bounds come from a sample, so the
    ranges are checkpointed before anything reads them.
    """
    checkpoints(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id()).checkpoint()


def totals_within(df: DataFrame, by: list[str], x: str, column: str) -> DataFrame:
    """`df` with `column` replaced by its sum over the rows of its group up to this x, and `_all`, the sum over all of them.

    x must be distinct within a group. Sums are made within ranges of (by, x), and those of the ranges before are added:
    they are one row for each range and group, so no group meets in one task.
    """
    rows = dealt(df, by, [x])
    part = Window.partitionBy(*by, "_p").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*by)
    sums = rows.groupBy(*by, "_p").agg(F.sum(column).alias("_s"))
    before = F.coalesce(F.sum("_s").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(k).alias(f"_g{k}") for k in by], F.col("_p").alias("_q"), before.alias("_before"), F.sum("_s").over(group).alias("_all"))
    on = [F.col("_p") == F.col("_q")] + [F.col(k).eqNullSafe(F.col(f"_g{k}")) for k in by]
    out = rows.withColumn(column, F.sum(column).over(part)).join(sums, on).withColumn(column, F.col(column) + F.col("_before"))
    return out.select(*df.columns, "_all")


def quantiles_by(df: DataFrame, by: list[str], x: str, shares: list[float]) -> DataFrame:
    """by, `quantiles`: the exact ones of each group's x with linear interpolation, in the order of `shares`; groups of nulls only are left out.

    Equal values are counted before they move, and a value knows its places in its group from the counts up to it; only the
    values that a share falls on or between are gathered.
    """
    values = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n")).withColumn("_up_to", F.col("_n"))
    run = totals_within(values, by, x, "_up_to")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("place")) for i, q in enumerate(shares)])
    at = lambda w, f: (f(w["place"]) >= F.col("_up_to") - F.col("_n")) & (f(w["place"]) < F.col("_up_to"))
    held = run.withColumn("_w", F.explode(F.filter(wanted, lambda w: at(w, F.floor) | at(w, F.ceil))))
    low, high = F.max(F.when(at(F.col("_w"), F.floor), F.col(x))), F.max(F.when(at(F.col("_w"), F.ceil), F.col(x)))
    each = held.groupBy(*by, "_w").agg(low.alias("a"), high.alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("_w.place") - F.floor("_w.place"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_w.i").alias("i"), value.alias("v")))), lambda e: e["v"]).alias("quantiles"))


def prefix_harmonic(df: DataFrame, x: str, ratio: str, by: list[str] | None = None) -> DataFrame:
    """With `prefix_mean`: the harmonic mean of the ratios of all rows up to this x, equal ones included."""
    by = by or []
    points = df.groupBy(*by, x).agg(F.count("*").alias("n"), F.sum(F.try_divide(F.lit(1.0), F.col(ratio))).alias("inverse"))
    if by:
        w = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
        points = points.withColumns({"n": F.sum("n").over(w), "inverse": F.sum("inverse").over(w)})
    else:
        points = running_totals(points, x, ["n", "inverse"])
    return points.select(*by, x, F.try_divide(F.col("n"), F.col("inverse")).alias("prefix_mean"))


def at_thresholds(curve: DataFrame, thresholds: DataFrame, x: str, value: str, by: list[str] | None = None) -> DataFrame:
    """The curve's value at each threshold: that of the largest x up to it; null below all. Thresholds are few."""
    keys = [*(by or []), "threshold"]
    t = F.broadcast(thresholds.select(*[F.col(k).alias(f"_{k}") for k in keys]))
    cond = curve[x] <= t["_threshold"]
    for k in by or []:
        cond = cond & (curve[k] == t[f"_{k}"])
    below = curve.join(t, cond).groupBy(*[F.col(f"_{k}").alias(k) for k in keys]).agg(F.max_by(value, x).alias(value))
    return thresholds.join(below, keys, "left")


def quantiles(df: DataFrame, x: str, shares: list[float]) -> DataFrame:
    """One row with `quantiles`, the exact ones of x with linear interpolation, in the order of `shares`.

    Values are counted and their counts summed by ranges; only the few values that the shares fall on are gathered.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("n")).withColumn("up_to", F.col("n"))
    run = running_totals(counts, x, ["up_to"])
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(shares)]))
    wanted = counts.agg(F.sum("n").alias("all")).select("all", at.alias("w")).select("w.i", (F.col("w.q") * (F.col("all") - 1)).alias("place"))
    ends = wanted.select("i", "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    held = run.join(F.broadcast(ends), (F.col("rank") >= F.col("up_to") - F.col("n")) & (F.col("rank") < F.col("up_to")))
    part = F.col("place") - F.floor("place")
    each = held.groupBy("i", "place").agg(F.min_by(x, "rank").alias("a"), F.max_by(x, "rank").alias("b")).select("i", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("v"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("quantiles"))


def log_grid(df: DataFrame, x: str, points: int, low: float = 0.15, by: list[str] | None = None) -> DataFrame:
    """threshold: `points` values evenly spaced in the logarithm from a quantile of x to its maximum, in each group of `by` if that is given."""
    ends = quantiles_by(df, by, x, [low, 1.0]) if by else quantiles(df, x, [low, 1.0])
    ends = ends.select(*(by or []), F.col("quantiles")[0].alias("_a"), F.col("quantiles")[1].alias("_b"))
    step = (F.ln("_b") - F.ln("_a")) / (points - 1)
    return ends.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(*(by or []), F.col("_i").alias("point"), F.exp(F.ln("_a") + F.col("_i") * step).alias("threshold"))


def quantile_edges(df: DataFrame, x: str, parts: int) -> DataFrame:
    """One row with the distinct edges of `parts` quantile buckets."""
    return quantiles(df, x, [i / parts for i in range(parts + 1)]).select(F.array_sort(F.array_distinct("quantiles")).alias("edges"))


def bucket_of(x: Column, edges: Column) -> Column:
    """The index of the right-closed bucket of x among sorted edges; the lowest edge is included."""
    return F.greatest(F.size(F.filter(edges, lambda e: e < x)) - 1, F.lit(0))


def median_pivot(df: DataFrame, bucket: str, buckets: int, model: str, models: list[str], value: str) -> DataFrame:
    """Medians by bucket, a column for each model; buckets without rows are there with nulls."""
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias(bucket))
    medians = quantiles_by(df, [bucket, model], value, [0.5]).select(bucket, model, F.col("quantiles")[0].alias("_m"))
    # A row for each bucket and model.
    wide = medians.groupBy(bucket).pivot(model, models).agg(F.max("_m"))
    return every.join(F.broadcast(wide), bucket, "left")


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to this row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def merged(df: DataFrame, by: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Ranges that overlap, touch or lie at most `gap` apart, joined."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def last_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def unique_by(df: DataFrame, key: Column) -> DataFrame:
    """Rows whose key no other row has. Rows of a key that repeats are merged before the shuffle."""
    once = df.groupBy(key.alias("_k")).agg(F.count("*").alias("_n"), F.first(F.struct(*df.columns)).alias("_row")).where("_n = 1")
    return once.select("_row.*")


def layout(tree: DataFrame, by: list[str]) -> DataFrame:
    """x offsets of a tree (node, parent, total): children beside each other in name order within their parent.

    A round places the children of the level before, until there are none; a level's siblings are placed by a running sum.
    Levels are checkpointed, so no round repeats the ones before. Nodes that no root leads to are left out.
    """
    checkpoints(tree.sparkSession)
    w = Window.partitionBy(*by, "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    rows = tree.withColumn("_inner", F.coalesce(F.sum("total").over(w), F.lit(0.0))).checkpoint()
    level = rows.where("parent is null").select(*by, "node", "parent", "total", F.lit(0).alias("depth"), F.col("_inner").alias("x"))
    out = level
    for depth in count(1):
        up = level.select(*by, F.col("node").alias("parent"), F.col("x").alias("_x"))
        level = rows.join(up, [*by, "parent"]).select(*by, "node", "parent", "total", F.lit(depth).alias("depth"), (F.col("_x") + F.col("_inner")).alias("x")).checkpoint()
        if not level.take(1):
            return out
        out = out.unionByName(level)
        if depth % 8 == 0:
            out = out.checkpoint()
    return out


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """With `position` from 1 in the order of columns that together are distinct.

    Rows are sorted within ranges, and the sizes of the ranges before, one row each, are added; no task gets all rows.
    """
    rows = dealt(df, [], order)
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_p", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("position", rank).join(F.broadcast(sizes), "_p").withColumn("position", F.col("position") + F.col("_before")).select(*df.columns, "position")


def greedy_cover(nodes: DataFrame, by: str, cap: float) -> DataFrame:
    """by, node, rank: deepest first, then by gain; a chosen node bans its ancestors; stops when `cap` of the gain is reached.

    Nodes are (by, node, depth, gain, ancestors). A choice depends on all earlier ones, so each group, one profile's
    functions, is folded in order as one array.
    """
    kind = dict(nodes.dtypes)
    item = F.struct((-F.col("depth")).alias("d"), (-F.col("gain")).alias("g"), F.col("node").alias("node"), F.col("ancestors").alias("ancestors"))
    groups = nodes.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"), (F.sum("gain") * cap).cast("double").alias("goal"))
    start = F.struct(F.lit(0.0).alias("got"), F.array().cast(f"array<{kind['node']}>").alias("banned"), F.array().cast(f"array<{kind['node']}>").alias("chosen"))

    def step(acc: Column, x: Column) -> Column:
        takes = (acc["got"] < F.col("goal")) & (x["g"] < 0) & ~F.array_contains(acc["banned"], x["node"])
        grown = F.struct((acc["got"] - x["g"]).cast("double").alias("got"), F.array_union(acc["banned"], x["ancestors"]).alias("banned"), F.array_append(acc["chosen"], x["node"]).alias("chosen"))
        return F.when(takes, grown).otherwise(acc)

    chosen = groups.select(by, F.aggregate("items", start, step, lambda acc: acc["chosen"]).alias("chosen"))
    return chosen.select(by, F.posexplode("chosen").alias("rank", "node")).select(by, "node", (F.col("rank") + 1).alias("rank"))


def minimal_patches(df: DataFrame, key: str, patch: str = "patch") -> DataFrame:
    """key, patch: each file's two header lines, and its hunks from the first changed line to the line behind the last.

    Hunks are counted anew, those of a file shift by the changes before them, and lines lose their trailing white space.
    Files that are new or gone have no old or new path and are left out; so are hunks without a change. Each patch is read
    within its row: it is split at its files and those at their hunks, so nothing is shuffled and no row is made of a line.
    """
    start = lambda x: F.when(x.startswith("@@"), F.regexp_extract(x, r"^@@\s+-(\d+),(\d+)\s+\+(\d+),(\d+)\s+@@", 1).try_cast("int"))
    changed = lambda x: x.startswith("+") | x.startswith("-")
    count = lambda xs, f: F.size(F.filter(xs, f))

    def bounds(part: Column) -> Column:
        """A part's lines, with the number of its hunk's first line and the places of its first and last change."""
        x = F.split(part, "\n")
        places = F.transform(x, lambda y, i: F.when(changed(y), i))
        return F.struct(x.alias("lines"), F.array_max(F.transform(x, start)).alias("old"), F.array_min(places).alias("a"), F.array_max(places).alias("b"))

    def kept(p: Column) -> Column:
        body = F.filter(F.slice(p["lines"], p["a"] + 1, p["b"] - p["a"] + 2), lambda y, j: start(y).isNull() & ((j <= p["b"] - p["a"]) | (y != "")))
        return F.struct((p["old"].cast("long") + count(F.slice(p["lines"], F.lit(1), p["a"]), lambda y: start(y).isNull())).alias("old"), body.alias("body"))

    def counted(h: Column) -> Column:
        return F.struct(h["old"].alias("old"), count(h["body"], lambda y: ~y.startswith("+")).alias("n_old"), count(h["body"], lambda y: ~y.startswith("-")).alias("n_new"), F.array_join(F.transform(h["body"], lambda y: F.rtrim(y)), "\n").alias("text"))

    def read(parts: Column) -> Column:
        heads = F.flatten(F.transform(F.filter(parts, lambda p: p["old"].isNull()), lambda p: F.filter(p["lines"], lambda y: y.startswith("--- a/") | y.startswith("+++ b/"))))
        hunks = F.transform(F.transform(F.filter(parts, lambda p: p["old"].isNotNull() & p["a"].isNotNull()), kept), counted)
        return F.struct(heads.alias("heads"), hunks.alias("hunks"))

    def shifted(f: Column) -> Column:
        """With the changes of the hunks before each one of a file."""
        shifts = F.aggregate(f["hunks"], F.array(F.lit(0).cast("long")), lambda acc, h: F.array_append(acc, F.element_at(acc, -1) + h["n_new"] - h["n_old"]))
        return F.struct(f["heads"].alias("heads"), f["hunks"].alias("hunks"), shifts.alias("shifts"))

    def written(f: Column) -> Column:
        hunk = lambda h, i: F.concat(F.lit("@@ -"), h["old"], F.lit(","), h["n_old"], F.lit(" +"), h["old"] + F.get(f["shifts"], i), F.lit(","), h["n_new"], F.lit(" @@\n"), h["text"])
        return F.concat(f["heads"], F.transform(f["hunks"], hunk))

    # Lines end at \n only, which the lookbehind says and ^ doesn't.
    files = F.filter(F.split(F.coalesce(patch, F.lit("")), r"(?<=\n)(?=--- a/)"), lambda x: x.startswith("--- a/"))
    files = F.transform(F.transform(files, lambda x: F.split(x, r"(?<=\n)(?=diff |@@ )")), lambda parts: F.transform(parts, bounds))
    files = F.transform(F.transform(F.transform(files, read), shifted), written)
    return df.select(key, F.array_join(F.flatten(files), "\n").alias(patch))
