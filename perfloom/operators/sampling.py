"""Deterministic stratified samples: the order within a stratum is that of a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.functions.numbers import log_bin
from perfloom.operators.ordered import range_of


def hash_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def binned(df: DataFrame, x: str, name: str, bins: int = 20) -> DataFrame:
    """With the log-spaced bin of x between the smallest and largest positive value."""
    ok = F.when(F.col(x) > 0, F.col(x))
    ends = df.agg(F.min(ok).alias("_lo"), F.max(ok).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.coalesce(log_bin(F.col(x), F.col("_lo"), F.col("_hi"), bins), F.lit(0))).drop("_lo", "_hi")


def quotas(sizes: DataFrame, total: int, bin: str = "bin", n: str = "n") -> DataFrame:
    """bin, quota: `total` shared out in proportion to n, by largest remainders, no more than n each. `sizes` has a row for each bin."""
    every = sizes.agg(F.sum(n).alias("_all"))
    rows = sizes.crossJoin(F.broadcast(every)).withColumn("_share", F.col(n) * F.least(F.lit(total), F.col("_all")) / F.col("_all"))
    rows = rows.withColumn("_base", F.floor("_share"))
    left = rows.agg((F.first(F.least(F.lit(total), F.col("_all"))) - F.sum("_base")).alias("_left"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("_share") - F.col("_base")), bin))
    return rows.withColumn("_rank", rank).crossJoin(F.broadcast(left)).select(bin, (F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("quota"))


def stratified(df: DataFrame, key: str, bin: str, total: int, seed: str = "") -> DataFrame:
    """`total` rows, each bin by its quota, those of the smallest hashes.

    Bins may be few and large. Ids are told apart by the first digits of their hashes: counts of these, which tasks make
    for themselves, say from which digits on no row of a bin can be in the sample, and only the others are ranked.
    """
    sizes = df.groupBy(bin).agg(F.count("*").alias("n"))
    q = F.broadcast(quotas(sizes, total, bin))
    rows = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_d", F.left("_h", F.lit(3)))
    up = Window.partitionBy(bin).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(bin, "_d").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(up), F.lit(0))).join(q, bin).where("_before < quota").select(bin, "_d")
    rows = rows.join(F.broadcast(reach), [bin, "_d"], "left_semi")
    w = Window.partitionBy(bin).orderBy("_h", key)
    return rows.withColumn("_n", F.row_number().over(w)).join(q, bin).where("_n <= quota").select(*df.columns)


def inverse_density(df: DataFrame, key: str, bins: list[str], total: int, seed: str = "") -> DataFrame:
    """`total` rows without replacement, rarer bins likelier: the largest keys of Efraimidis and Spirakis with weights 1 / bin size, multiplied over `bins`."""
    rows, weight = df, F.lit(1.0)
    for i, b in enumerate(bins):
        # A bin's size is one row; there are few bins.
        rows = rows.join(F.broadcast(df.groupBy(b).agg(F.count("*").alias(f"_c{i}"))), b)
        weight = weight / F.col(f"_c{i}")
    u = (F.conv(F.left(hash_order(F.col(key), seed), F.lit(12)), 16, 10).cast("double") + 1) / float(1 << 48)
    return rows.withColumn("_k", -F.ln(u) / weight).orderBy("_k", key).limit(total).select(*df.columns)


def three_way(df: DataFrame, key: str, columns: list[str], total: int, seed: str = "") -> DataFrame:
    """A third of `total` by each column's bins, the union, topped up by inverse density and cut to `total`."""
    rows, parts = df, None
    for i, c in enumerate(columns):
        rows = binned(rows, c, f"bin_{i}")
    names = [f"bin_{i}" for i in range(len(columns))]
    share = [total // len(columns)] * (len(columns) - 1)
    for n, b in zip([*share, total - sum(share)], names, strict=True):
        part = stratified(rows, key, b, n, seed + b).select(key)
        parts = part if parts is None else parts.unionAll(part)
    chosen = parts.distinct()
    more = inverse_density(rows.join(chosen, key, "left_anti"), key, names, total, seed)
    first = rows.join(chosen, key, "left_semi").withColumn("_o", F.lit(0))
    return first.unionByName(more.withColumn("_o", F.lit(1))).orderBy("_o", hash_order(F.col(key), seed), key).limit(total).drop("_o")


def splits(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """With `split` from 1: n contiguous parts of nearly equal size, in order, the larger ones first.

    Rows are ranked within ranges of the first column, and the ranges' sizes are added, so no task gets all rows.
    """
    rows = df.withColumn("_p", range_of(df, order[0]))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(F.lit(0)).orderBy("_p")
    sizes = sizes.withColumn("_before", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).withColumn("_all", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    out = rows.withColumn("_i", rank).join(F.broadcast(sizes), "_p").withColumn("_r", F.col("_before") + F.col("_i"))
    # The first _all % n parts have one row more.
    large = F.expr(f"(_all % {n}) * (_all div {n} + 1)")
    rest = F.expr(f"_all % {n} + (_r - (_all % {n}) * (_all div {n} + 1)) div greatest(_all div {n}, 1)")
    part = F.when(F.col("_r") < large, F.expr(f"_r div (_all div {n} + 1)")).otherwise(rest)
    return out.withColumn("split", (part + 1).cast("int")).select(*df.columns, "split")
