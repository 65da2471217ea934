"""Ranges of whole numbers of any length: stabbing, overlap, containment, what ranges leave of each other, and their dyadic blocks.

Joins go by a sweep: points and ranges of a key are rows of one table, shuffled once as they are and met in the order of
their numbers, so a range costs one row whatever its length, without a width to choose. Keys with very many rows are dealt
out by their numbers. Numbers are taken between -2^61 and 2^61; ranges with a null end, or whose end is before their start,
are empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def blocks(start: str, end: str) -> Column:
    """The aligned blocks (level, block) that make up the closed range of two columns; no blocks for an empty range."""
    s, past = F.col(start).cast("long"), F.col(end).cast("long") + 1
    down = lambda x, l: F.call_function("shiftright", x, l)
    # One level more than the length's logarithm, against its rounding.
    top = F.least(F.floor(F.log2(F.greatest(past - s, F.lit(1)))).cast("int") + 1, F.lit(62))

    def at(l: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), l)
        low, high = down(s + size - 1, l), down(past, l)
        node = lambda ok, block: F.when((low < high) & (ok % 2 != 0), F.struct(l.alias("level"), block.alias("block")))
        return F.array(node(low, low), node(high, high - 1))

    every = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), at)), lambda n: n.isNotNull())
    return F.when(F.col(start) <= F.col(end), every)


#: Rows of a key beyond which it is dealt out by its numbers.
HOT = 1_000_000
#: Pairs of a batch that a sweep gives back.
PAIRS = 50_000


def _hot(ends: DataFrame, by: list[str], hot: int) -> DataFrame | None:
    """by, _bounds: what parts the numbers `_at` of each key with more than `hot` rows into as many pieces as a shuffle has partitions; None if no key has."""
    from perfloom.operators.graph import checkpoints  # which reads this module

    checkpoints(ends.sparkSession)
    large = ends.groupBy(*by).agg(F.count("*").alias("_n")).where(f"_n > {hot}").drop("_n").checkpoint()
    if not large.take(1):
        return None
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / n) for i in range(1, max(n, 2))])
    return ends.join(F.broadcast(large), by, "left_semi").groupBy(*by).agg(F.array_distinct(F.percentile_approx("_at", shares, 1000)).alias("_bounds")).checkpoint()


def _piece(x: Column) -> Column:
    """The piece of its key that a number lies in; a key that is not dealt out has one."""
    return F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda b: b < x)))


def _laid(points: DataFrame, spans: DataFrame, by: list[str], hot: int, across=None) -> DataFrame:
    """Points (by, _at, _point) and ranges (by, _at, _end, _span) as rows of one table with `_p`, the piece of the key that they belong to.

    A range goes to every piece that it touches, with `across` to those of its ends only: `across` says what the pieces
    between get, from rows with `_from` and `_upto`.
    """
    bounds = _hot(points.select(*by, "_at").unionByName(spans.select(*by, "_at")), by, hot)
    if bounds is None:
        points, spans = points.withColumn("_p", F.lit(0)), spans.withColumn("_p", F.lit(0))
    else:
        place = lambda df: df.join(F.broadcast(bounds), by, "left")
        points = place(points).withColumn("_p", _piece(F.col("_at"))).drop("_bounds")
        wide = place(spans).withColumns({"_from": _piece(F.col("_at")), "_upto": _piece(F.col("_end"))}).drop("_bounds")
        touched = F.sequence("_from", "_upto") if across is None else F.array_distinct(F.array("_from", "_upto"))
        spans = wide.withColumn("_p", F.explode(touched)).drop("_from", "_upto")
        if across is not None:
            spans = spans.unionByName(across(wide.where("_upto > _from + 1")).select(*spans.columns))
    return points.withColumn("_kind", F.lit(1)).unionByName(spans.withColumn("_kind", F.lit(0)), allowMissingColumns=True)


def _meet(laid: DataFrame, by: list[str], first: bool) -> DataFrame:
    """Columns of `_point` and `_span` for each point and each range around it, with `first` the least range by (length, start, value) only.

    One sorted pass over the rows of each key's piece. It holds the ranges around the place that it has come to.
    """
    keys, given = [*by, "_p"], [*by, "_at", "_point"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, around, pushed = None, [], 0
        for batch in batches:
            took, met = [], []

            def made(batch=batch, took=took, met=met):
                return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(took, pa.int64())) for c in given] + [pa.array(met, batch.schema.field("_span").type)], [*given, "_span"])

            rows = zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), *[batch.column(c).to_pylist() for c in ("_at", "_kind", "_end", "_span")], strict=True)
            for i, (key, at, kind, end, span) in enumerate(rows):
                if key != group:
                    group, around = key, []
                if kind == 0:
                    pushed += 1
                    value = next(iter(span.values()), None) if first else None
                    heapq.heappush(around, ((end - at, at, value is not None, value, pushed) if first else (end, pushed), end, span))
                    continue
                while around and around[0][1] < at:
                    heapq.heappop(around)
                for _, _, span in around[:1] if first else around:
                    took.append(i)
                    met.append(span)
                    if len(took) >= PAIRS:
                        yield made()
                        took.clear()
                        met.clear()
            yield made()

    rows = laid.select(*keys, "_at", "_kind", "_end", "_span", "_point").repartition(*keys).sortWithinPartitions(*keys, "_at", "_kind")
    return rows.mapInArrow(sweep, StructType([laid.schema[c] for c in (*given, "_span")])).select(*by, "_at", "_point.*", "_span.*")


def _points(points: DataFrame, by: list[str], point: str) -> DataFrame:
    known = points.where(F.col(point).isNotNull()).dropna(subset=by) if by else points.where(F.col(point).isNotNull())
    return known.select(*by, F.col(point).cast("long").alias("_at"), F.struct(*[F.col(c) for c in points.columns if c not in by and c != point], F.lit(True).alias("_")).alias("_point"))


def _spans(spans: DataFrame, by: list[str], start: str, end: str, columns: list[str]) -> DataFrame:
    whole = spans.where(F.col(start) <= F.col(end))
    whole = whole.dropna(subset=by) if by else whole
    return whole.select(*by, F.col(start).cast("long").alias("_at"), F.col(end).cast("long").alias("_end"), F.struct(*[F.col(c) for c in columns]).alias("_span"))


def stabbed(points: DataFrame, spans: DataFrame, by: list[str], point: str, start: str, end: str, hot: int = HOT) -> DataFrame:
    """Pairs of a point and a range that holds it, within `by`: columns of both, each pair once.

    Points and ranges are shuffled once, as they are, and met in the order of their numbers, so rows are as many as those of
    the input and the pairs. A key of more than `hot` rows is dealt out by its numbers.
    """
    others = [c for c in spans.columns if c not in by]
    laid = _laid(_points(points, by, point), _spans(spans, by, start, end, others), by, hot)
    return _meet(laid, by, False).withColumnRenamed("_at", point).select(*by, *[c for c in points.columns if c not in by], *others)


def overlapping(a: DataFrame, b: DataFrame, by: list[str], a_range: tuple[str, str], b_range: tuple[str, str], hot: int = HOT) -> DataFrame:
    """Pairs of rows whose closed ranges intersect, within `by`.

    Of two such ranges, the one that starts later starts within the other: `b` starts within `a`, or `a` within `b` behind
    its start. Each pair comes from one of the two joins, once.
    """
    whole = lambda df, r: df.where(F.col(r[0]) <= F.col(r[1]))
    a, b = whole(a, a_range), whole(b, b_range)
    later = stabbed(b, a, by, b_range[0], *a_range, hot=hot)
    earlier = stabbed(a, b, by, a_range[0], *b_range, hot=hot).where(F.col(a_range[0]) > F.col(b_range[0]))
    return later.select(*earlier.columns).unionByName(earlier)


def contained(points: DataFrame, spans: DataFrame, by: list[str], point: tuple[str, str], span: tuple[str, str], hot: int = HOT) -> DataFrame:
    """Rows of `points` whose half-open range lies within one of `spans`; null keys equal each other.

    It does if the farthest end of the ranges that start no later is no earlier than its own: a running maximum over points
    and ranges together, each of them one row. The pieces of a key that is dealt out get the maximum of those before.
    """
    at = lambda df, c: df.withColumn("_at", F.col(c).cast("long"))
    points = at(points.where(F.col(point[0]) <= F.col(point[1])), point[0])
    spans = at(spans.where(F.col(span[0]) <= F.col(span[1])), span[0]).select(*by, "_at", F.col(span[1]).cast("long").alias("_end"))
    bounds = _hot(points.select(*by, "_at").unionByName(spans.select(*by, "_at")), by, hot)
    place = lambda df: df.withColumn("_p", F.lit(0)) if bounds is None else df.join(F.broadcast(bounds), by, "left").withColumn("_p", _piece(F.col("_at"))).drop("_bounds")
    points, spans = place(points), place(spans)
    if bounds is not None:
        before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        every = points.select(*by, "_p", F.lit(None).cast("long").alias("_end")).unionByName(spans.select(*by, "_p", "_end")).join(F.broadcast(bounds.select(*by)), by, "left_semi")
        carried = every.groupBy(*by, "_p").agg(F.max("_end").alias("_end")).withColumn("_end", F.max("_end").over(before)).where("_end is not null")
        spans = spans.unionByName(carried.withColumn("_at", F.lit(None).cast("long")))
    rows = points.withColumn("_kind", F.lit(1)).unionByName(spans.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(*by, "_p").orderBy(F.asc_nulls_first("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    keep = [c for c in points.columns if c not in ("_at", "_p")]
    return rows.withColumn("_far", F.max("_end").over(upto)).where((F.col("_kind") == 1) & (F.col(point[1]) <= F.col("_far"))).select(*keep)


def smallest_span(points: DataFrame, spans: DataFrame, by: list[str], point: str, start: str, end: str, name: str, hot: int = HOT) -> DataFrame:
    """points with `name` of the shortest span around each point, the earliest of several; points in none are left out.

    A sweep keeps the spans around its place by length. Of the spans that a piece of a hot key lies in whole it gets the
    shortest one only.
    """

    def across(wide: DataFrame) -> DataFrame:
        row = F.struct((F.col("_end") - F.col("_at")).alias("length"), "_at", "_span", "_end")
        best = wide.groupBy(*by, "_from", "_upto").agg(F.min(row).alias("_r")).withColumn("_p", F.explode(F.expr("sequence(_from + 1, _upto - 1)")))
        return best.groupBy(*by, "_p").agg(F.min("_r").alias("_r")).select(*by, "_p", "_r._at", "_r._end", "_r._span")

    laid = _laid(_points(points.distinct(), by, point), _spans(spans, by, start, end, [name]), by, hot, across)
    return _meet(laid, by, True).withColumnRenamed("_at", point).select(*points.columns, name)


def _swept(ranges: DataFrame, by: list[str], start: str, end: str, sets: list[str]) -> DataFrame:
    """Where each piece between neighbouring ends lies, with the number of ranges of each set (column `_set`) over it.

    One sorted pass within `by`, over the ends, which are counted before the shuffle.
    """
    rows = ranges.where(F.col(start) <= F.col(end))
    ends = rows.select(*by, F.explode(F.array(*[F.struct(at.cast("long").alias("at"), F.col("_set").alias("set"), F.lit(d).alias("d")) for at, d in ((F.col(start), 1), (F.col(end) + 1, -1))])).alias("_e"))
    steps = ends.groupBy(*by, F.col("_e.at").alias("_at")).agg(*[F.sum(F.when(F.col("_e.set") == s, F.col("_e.d")).otherwise(0)).alias(f"_{s}") for s in sets])
    w = Window.partitionBy(*by).orderBy("_at")
    return steps.withColumns({f"_{s}": F.sum(f"_{s}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for s in sets} | {"_next": F.lead("_at").over(w)})


def _joined(pieces: DataFrame, by: list[str], ok: Column, start: str, end: str) -> DataFrame:
    """Neighbouring pieces that are `ok`, as closed ranges."""
    w = Window.partitionBy(*by).orderBy("_at")
    rows = pieces.withColumn("_ok", ok).withColumn("_new", (F.col("_ok") & ~F.coalesce(F.lag("_ok").over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_ok")
    return rows.groupBy(*by, "_run").agg(F.min("_at").alias(start), (F.max("_next") - 1).alias(end)).drop("_run")


def covered(ranges: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The numbers in any of the ranges, as the fewest closed ranges: those that overlap or follow each other become one."""
    pieces = _swept(ranges.select(*by, start, end, F.lit("a").alias("_set")), by, start, end, ["a"])
    return _joined(pieces, by, F.col("_a") > 0, start, end)


def uncovered(ranges: DataFrame, known: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """The numbers in any of `ranges` and in none of `known`, as the fewest closed ranges."""
    both = ranges.select(*by, start, end, F.lit("a").alias("_set")).unionByName(known.select(*by, start, end, F.lit("k").alias("_set")))
    return _joined(_swept(both, by, start, end, ["a", "k"]), by, (F.col("_a") > 0) & (F.col("_k") == 0), start, end)
