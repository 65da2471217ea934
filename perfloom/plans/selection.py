"""Which instances and runs take part, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfloom.functions import diffs as D
from perfloom.functions.text import stripped
from perfloom.operators import joins as J


def by_id(rows: DataFrame, pattern: str, key: str = "instance_id") -> DataFrame:
    """Rows whose id has a match of the pattern anywhere."""
    return rows.where(F.col(key).rlike(pattern))


def has_text(text: Column) -> Column:
    """True for a text that is there: not null, blank or `nan`."""
    return ~stripped(text).isin("", "nan")


def runnable(instances: DataFrame, predictions: DataFrame, allow_tests: bool = False) -> DataFrame:
    """Instances with a prediction; those that change tests only if that is allowed."""
    rows = J.keep(instances, predictions, "instance_id")
    return rows if allow_tests else rows.where(~has_text(F.col("test_patch")))


def with_patch(predictions: DataFrame) -> DataFrame:
    return predictions.where("coalesce(model_patch, '') <> ''")


def to_run(predictions: DataFrame, instances: DataFrame, done: DataFrame) -> DataFrame:
    """Predictions with a patch, for known instances, that have no result yet; an unknown instance is an error."""
    J.require(predictions, instances, "instance_id", "instances")
    return J.drop(with_patch(predictions), done, "instance_id")


def short_patches(rows: DataFrame, a: str, b: str, most: int = 40) -> DataFrame:
    """Rows whose patches both have at most `most` lines."""
    return rows.where((D.total_lines(F.col(a)) <= most) & (D.total_lines(F.col(b)) <= most))


def agent_steps(history: Column) -> Column:
    """The steps of a trajectory that an agent took."""
    return F.size(F.filter(history, lambda h: h["action"].isNotNull() & (h["source"] == "agent")))


def spread(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """In the order of a hash, so that long runs of like rows are spread."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key)


def successes(scored: DataFrame, least: float = 1.0) -> DataFrame:
    """Correct rows that aren't slower, the nearest to the expert first."""
    return scored.where((F.col("correctness") == 1) & (F.col("raw_pred_speedup_ratio") >= least)).orderBy(F.desc("human_speedup_ratio"), "instance_id")


def by_overlap_and_depth(rows: DataFrame, overlap: str, depth: str, key: str) -> DataFrame:
    """Least overlap first, a missing one as 0; then least depth, a missing or zero one last."""
    deep = F.coalesce(F.nullif(F.col(depth), F.lit(0)).cast("double"), F.lit(float("inf")))
    return rows.orderBy(F.coalesce(overlap, F.lit(0.0)), deep, key)


def disagreements(a: DataFrame, b: DataFrame, label: str, correctness: DataFrame) -> DataFrame:
    """One row: correct instances of both sides, and how many have different labels."""
    right = correctness.where("correctness = 1").select("instance_id")
    both = a.select("instance_id", F.col(label).alias("_a")).join(b.select("instance_id", F.col(label).alias("_b")), "instance_id")
    return J.keep(both, right, "instance_id").agg(F.count("*").alias("n"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("different"))
