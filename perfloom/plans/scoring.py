"""The scored report: expert and predicted runtimes joined to instances, gated by correctness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfloom.functions import numbers as N
from perfloom.operators import aggregates as A


def report(instances: DataFrame, pred: DataFrame, gold: DataFrame, correctness: DataFrame, key: str = "instance_id") -> DataFrame:
    """A row for each instance.

    pred and gold hold (key, before, after), correctness (key, passed, expected). A missing summary counts as a ratio
    of 1; without correctness output the raw ratio is null, and the instance is incorrect.
    """
    side = lambda df, p: df.select(key, F.col("before").alias(f"{p}_before"), F.col("after").alias(f"{p}_after"))
    rows = instances.join(side(pred, "pred"), key, "left").join(side(gold, "gold"), key, "left").join(correctness.select(key, "passed", "expected"), key, "left")
    measured = F.col("passed").isNotNull()
    raw = F.when(measured, F.coalesce(N.speedup(F.col("pred_before"), F.col("pred_after")), F.lit(1.0)))
    rows = rows.withColumn("raw_pred_speedup_ratio", raw)
    rows = rows.withColumn("gold_speedup_ratio", F.coalesce(N.speedup(F.col("gold_before"), F.col("gold_after")), F.lit(1.0)))
    rows = rows.withColumn("correctness_pct", F.when(measured, A.pass_fraction(F.col("passed"), F.col("expected"))).otherwise(0.0))
    rows = rows.withColumn("correctness", (F.col("correctness_pct") == 1).cast("double"))
    rows = rows.withColumn("pred_speedup_ratio", N.gated(F.coalesce("raw_pred_speedup_ratio", F.lit(1.0)), F.col("correctness")))
    rows = rows.withColumn("human_speedup_ratio", N.human_ratio(F.col("pred_speedup_ratio"), F.col("gold_speedup_ratio")))
    rows = rows.withColumn("pre_edit_runtime", F.col("gold_before"))
    return rows.drop("pred_before", "pred_after", "gold_before", "gold_after", "passed", "expected")


def summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means and outcome shares of a report."""
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        A.harmonic_mean(F.col("human_speedup_ratio")).alias("harmonic_mean"),
        A.geometric_mean(F.col("human_speedup_ratio")).alias("geometric_mean"),
        (F.avg("correctness") * 100).alias("correct_percent"),
        *A.outcomes(F.col("raw_pred_speedup_ratio"), F.col("correctness"), F.col("human_speedup_ratio")),
    )
