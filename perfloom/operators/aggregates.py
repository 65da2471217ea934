"""Aggregates: means of ratios, gates, transitions, sets and costs. All are plain aggregate expressions unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfloom.functions.numbers import known, positive_finite


def harmonic_mean(x: Column) -> Column:
    """n / sum(1/x) over all values that aren't null; 0 if any is 0."""
    return F.when(F.max((x == 0).cast("int")) == 1, F.lit(0.0)).otherwise(F.try_divide(F.count(x), F.sum(F.try_divide(F.lit(1.0), x))))


def harmonic_mean_positive(x: Column) -> Column:
    """As `harmonic_mean` of the positive finite values; null without any."""
    ok = positive_finite(x)
    return F.try_divide(F.count_if(ok), F.sum(F.when(ok, F.try_divide(F.lit(1.0), x))))


def geometric_mean(x: Column) -> Column:
    """Of the positive values."""
    return F.exp(F.avg(F.when(x > 0, F.ln(x))))


def statistics(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """mean, min, max and count of each column, without nulls and NaN."""
    out = []
    for c in columns:
        x = known(F.col(c).cast("double"))
        out += [F.avg(x).alias(f"{c}_mean"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.count(x).alias(f"{c}_count")]
    return df.groupBy(*(by or [])).agg(*out)


def counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows by group, the largest group first."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def length_summary(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sd, min, quartiles and max of a text's length."""
    from perfloom.operators.ordered import quantiles

    lengths = df.select(F.length(column).cast("double").alias("_l"))
    whole = lengths.agg(F.count("_l").alias("count"), F.avg("_l").alias("mean"), F.stddev_samp("_l").alias("sd"), F.min("_l").alias("min"), F.max("_l").alias("max"))
    quarters = quantiles(lengths, "_l", [0.25, 0.5, 0.75]).select(*[F.col("quantiles")[i].alias(f"q{q}") for i, q in enumerate((25, 50, 75))])
    # One row each.
    return whole.crossJoin(F.broadcast(quarters)).select("count", "mean", "sd", "min", "q25", "q50", "q75", "max")


def fingerprint(df: DataFrame, columns: list[str]) -> list[Column]:
    """Aggregates that are equal for equal multisets of rows, in any order, and can be merged: the count, and sum and xor of two 64-bit hashes.

    Different multisets agree with a chance of about 2^-128. Map columns have no order and can't be hashed; give them as arrays.
    """
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    return [F.count("*").alias("rows"), F.sum(one.cast("decimal(20,0)")).alias("sum"), F.bit_xor(two).alias("xor")]


def same_rows(a: DataFrame, b: DataFrame, as_sets: bool = False) -> DataFrame:
    """One row, `same`: whether two tables have the same rows, as often as each other, or with `as_sets` however often.

    Each side is read once and nothing of it is shuffled but its fingerprint; only as sets are rows brought together, to be told apart.
    """
    if as_sets:
        a, b = a.distinct(), b.select(*a.columns).distinct()
    sides = [df.agg(F.struct(*fingerprint(df, a.columns)).alias(n)) for df, n in ((a, "x"), (b, "y"))]
    return sides[0].crossJoin(F.broadcast(sides[1])).select(F.col("x").eqNullSafe(F.col("y")).alias("same"))


def outcomes(raw: Column, correctness: Column, human: Column) -> list[Column]:
    """Shares of rows that are incorrect, correct but slower, faster but below the expert, or at the expert and above. They add up to 1."""
    right = correctness == 1
    share = lambda c, name: F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(name)
    return [
        F.avg((~F.coalesce(right, F.lit(False))).cast("double")).alias("incorrect"),
        share(right & (raw < 1), "slower"),
        share(right & (raw >= 1) & (human < 1), "below_expert"),
        share(right & (raw >= 1) & (human >= 1), "expert"),
    ]


def pass_fraction(passed: Column, expected: Column) -> Column:
    """passed / expected; 1 if nothing is expected."""
    return F.when(expected == 0, F.lit(1.0)).otherwise(passed / expected)


def resolution(f2p: Column, p2p: Column) -> Column:
    """FULL, PARTIAL or NO from the rates of tests to fix and tests to keep."""
    return F.when((f2p == 1) & (p2p == 1), "FULL").when((f2p < 1) & (f2p > 0) & (p2p == 1), "PARTIAL").otherwise("NO")


def transitions(before: DataFrame, after: DataFrame, key: list[str], status: str) -> DataFrame:
    """key, from, to for tests of either run; one that is skipped in or absent from the second is left out."""
    a, b = before.select(*key, F.col(status).alias("from")), after.where(f"{status} <> 'SKIP'").select(*key, F.col(status).alias("to"))
    return b.join(a, key, "left").select(*key, F.coalesce("from", F.lit("NONE")).alias("from"), "to")


def transition_lists(rows: DataFrame, by: list[str], test: str) -> DataFrame:
    """The tests of each transition, sorted."""
    one = lambda a, b: F.array_sort(F.collect_list(F.when((F.col("from") == a) & (F.col("to") == b), F.col(test)))).alias(f"{a}_{b}".lower())
    return rows.groupBy(*by).agg(*[one(a, b) for a in ("PASS", "FAIL") for b in ("PASS", "FAIL")])


def outcome_sets(df: DataFrame, label: str, key: str, labels: list[str], by: list[str] | None = None) -> DataFrame:
    """The count and the sorted ids of each label."""
    out = []
    for v in labels:
        out += [F.count_if(F.col(label) == v).alias(f"{v}_count"), F.array_sort(F.collect_set(F.when(F.col(label) == v, F.col(key)))).alias(f"{v}_ids")]
    return df.groupBy(*(by or [])).agg(F.count("*").alias("total"), *out)


def grouped_lists(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    return df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))


def flaky(runs: DataFrame, key: list[str], status: str) -> DataFrame:
    """key, statuses, flaky: whether a test has more than one status over the runs."""
    return runs.groupBy(*key).agg(F.count_distinct(status).alias("statuses")).withColumn("flaky", F.col("statuses") > 1)


def overlap(a: Column, b: Column) -> Column:
    """struct<jaccard, precision, recall, f1, hit, exact> of two sets; a, the truth, and b without elements give null."""
    both = F.size(F.array_intersect(a, b))
    p, r = F.try_divide(both, F.size(F.array_distinct(b))), F.try_divide(both, F.size(F.array_distinct(a)))
    return F.struct(
        F.try_divide(both, F.size(F.array_union(a, b))).alias("jaccard"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.when(p.isNotNull() & r.isNotNull(), 0.0)).alias("f1"),
        (both > 0).alias("hit"), ((both == F.size(F.array_union(a, b))) & (both > 0)).alias("exact"),
    )


def overlap_means(df: DataFrame, measure: str) -> DataFrame:
    """Macro means over all rows, null measures as 0, and over the rows that have one."""
    m = lambda c: F.col(f"{measure}.{c}").cast("double")
    names = ("jaccard", "precision", "recall", "f1")
    return df.agg(*[F.avg(F.coalesce(m(c), F.lit(0.0))).alias(f"macro_{c}") for c in names], *[F.avg(m(c)).alias(f"evaluated_{c}") for c in names], F.avg(m("hit")).alias("hit_rate"), F.avg(m("exact")).alias("exact_rate"))


def overlap_totals(df: DataFrame, truth: str, found: str) -> DataFrame:
    """One row of how two columns of sets agree. Rows where both are empty are skipped; macro means divide by all rows all the same.

    Micro Jaccard is the sum of common elements over the sum of united ones. Without anything found precision is 0, without
    truth recall is 0.
    """
    g, p = F.size(F.array_distinct(truth)), F.size(F.array_distinct(found))
    rows = df.select(g.alias("g"), p.alias("p"), F.size(F.array_intersect(truth, found)).alias("both"), F.size(F.array_union(truth, found)).alias("either")).withColumn("used", F.col("either") > 0)
    prec, rec = F.coalesce(F.try_divide("both", "p"), F.lit(0.0)), F.coalesce(F.try_divide("both", "g"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    macro = lambda x, name: F.coalesce(F.try_divide(F.sum(F.when(F.col("used"), x)), F.count("*")), F.lit(0.0)).alias(name)
    rate = lambda c, name: F.coalesce(F.try_divide(F.count_if(F.col("used") & c), F.count_if("used")), F.lit(0.0)).alias(name)
    return rows.agg(
        F.count_if("used").alias("evaluated"), F.count_if(~F.col("used")).alias("skipped"), rate(F.col("both") > 0, "hit_rate"), rate(F.col("both") == F.col("either"), "exact_rate"),
        macro(F.try_divide("both", "either"), "macro_jaccard"), macro(prec, "macro_precision"), macro(rec, "macro_recall"), macro(f1, "macro_f1"),
        F.coalesce(F.try_divide(F.sum("both"), F.sum("either")), F.lit(0.0)).alias("micro_jaccard"),
    )


def extension_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """ext, n: how often the files of either set of a row end with each extension; files without one count as an empty one."""
    files = df.select(F.explode(F.array_union(a, b)).alias("_f"))
    return files.groupBy(F.regexp_extract("_f", r"[^/](\.[^./]+)$", 1).alias("ext")).agg(F.count("*").alias("n"))


def slowest_runs(runs: DataFrame, key: str, seconds: str, limit: float = 600.0) -> DataFrame:
    """key, longest, all_below: the longest time over the runs that report one, and whether each of these is below `limit`."""
    return runs.groupBy(key).agg(F.max(seconds).alias("longest"), F.coalesce(F.bool_and(F.col(seconds) < limit), F.lit(True)).alias("all_below"))


def selected_histogram(df: DataFrame, bin: str, selected: Column) -> DataFrame:
    """bin, n, n_selected."""
    return df.groupBy(bin).agg(F.count("*").alias("n"), F.count_if(selected).alias("n_selected"))


def expert_coverage(expert: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """by, file_coverage, func_coverage, wrong_file_loss, in_file_loss from positive gains (file, func, gain).

    Coverage is the share of the expert's gain in files, or functions, that the other has gains in too.
    """
    e, o = expert.where("gain > 0"), other.where("gain > 0")
    e = e.join(o.select(*by, "file", F.lit(True).alias("_file")).distinct(), [*by, "file"], "left").join(o.select(*by, "file", "func", F.lit(True).alias("_func")).distinct(), [*by, "file", "func"], "left")
    share = lambda c: F.try_divide(F.sum(F.when(F.col(c), F.col("gain")).otherwise(0.0)), F.sum("gain"))
    out = e.groupBy(*by).agg(share("_file").alias("file_coverage"), share("_func").alias("func_coverage"))
    return out.withColumn("wrong_file_loss", 1 - F.col("file_coverage")).withColumn("in_file_loss", F.greatest(F.lit(0.0), F.col("file_coverage") - F.col("func_coverage")))


def weighted_depth(weight: Column, depth: Column) -> list[Column]:
    """The mean depth by positive weights, and the share of weight that has a depth."""
    w = F.when(weight > 0, weight)
    held = F.when(depth.isNotNull(), w)
    return [F.try_divide(F.sum(held * depth), F.sum(held)).alias("depth"), F.try_divide(F.sum(held), F.sum(w)).alias("covered")]


def token_totals(df: DataFrame, usage: str, by: list[str]) -> DataFrame:
    """Sums of a map's values by key."""
    return df.select(*by, F.explode(usage).alias("kind", "n")).groupBy(*by, "kind").agg(F.sum("n").alias("n"))


def priced(usage: DataFrame, prices: DataFrame, model: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Cost in exact decimals of the columns input, output, cache_write, cache_write_hour and cache_read by prices a million tokens.

    Input holds the cached tokens too; what is left of it must not be negative.
    """
    name = F.col(model)
    for a, b in (aliases or {}).items():
        name = F.when(name == a, F.lit(b)).otherwise(name)
    rows = usage.withColumn(model, name).join(F.broadcast(prices), model)
    base = F.col("input") - F.col("cache_write") - F.col("cache_write_hour") - F.col("cache_read")
    base = F.when(base < 0, F.raise_error(F.lit("cached tokens exceed the input")).cast("long")).otherwise(base)
    cost = lambda n, price: n.cast("decimal(20,0)") * F.col(price).cast("decimal(12,6)") / F.lit(1_000_000).cast("decimal(8,0)")
    parts = {"base_cost": cost(base, "base_in"), "write_cost": cost(F.col("cache_write"), "write_5m"), "hour_cost": cost(F.col("cache_write_hour"), "write_1h"), "read_cost": cost(F.col("cache_read"), "hit"), "output_cost": cost(F.col("output"), "out")}
    rows = rows.withColumns(parts)
    total = F.lit(0).cast("decimal(38,12)")
    for p in parts:
        total = total + F.col(p)
    return rows.withColumn("total_cost", total)


def bad_run(delta: Column, improvement: Column, after_sd: Column) -> Column:
    """A run is bad if it isn't faster, or if it gains less than a quarter and less than one standard deviation."""
    return (delta >= 0) | ((improvement > -25) & (F.abs(delta) < after_sd))


def not_two_sigma(before: Column, after: Column, after_sd: Column) -> Column:
    return after > before - 2 * after_sd


def one_sigma_faster(before: Column, before_sd: Column, after: Column, after_sd: Column) -> Column:
    return before - after > F.greatest(before_sd, after_sd)


def histogram(df: DataFrame, bin: Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), bin.alias("bin")).agg(F.count("*").alias("n"))
