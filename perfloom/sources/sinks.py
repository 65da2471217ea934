"""Sinks of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfloom.functions.text import stripped


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def run_report(labelled: DataFrame, label: str, key: str) -> DataFrame:
    """One row with the counts and sorted ids of a run's outcomes, and the schema's version."""
    from perfloom.operators.aggregates import outcome_sets

    return outcome_sets(labelled, label, key, ["completed", "resolved", "unresolved", "empty_patch", "error"]).withColumn("schema_version", F.lit(2))


def valid_and_tested(df: DataFrame, all_path: str, tested_path: str) -> None:
    """Appends all rows, and those with a test patch, to two JSONL folders."""
    rows = df.persist()
    try:
        json(rows, all_path, "append")
        json(rows.where(stripped(F.col("test_patch")) != ""), tested_path, "append")
    finally:
        rows.unpersist()


def merge_shards(df: DataFrame, path: str, rows_a_file: int = 1_000_000, remove: bool = False) -> None:
    """All shards that `df` was read from, in as few files as `rows_a_file` allows: one for small data.

    With `remove` the shards go once the merged files are written; none of them may be below `path`.
    """
    shards = df.inputFiles() if remove else []
    spark, inside = df.sparkSession, [s for s in shards if f"{path.rstrip('/')}/" in s]
    if inside:
        raise ValueError(f"shards lie in the folder that they are merged to: {inside[0]}")
    files = max(1, -(-df.count() // rows_a_file))
    (df.coalesce(1) if files == 1 else df.repartition(files)).write.mode("overwrite").json(path)
    for shard in shards:
        file = spark._jvm.org.apache.hadoop.fs.Path(shard)
        file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False)


def bundles(df: DataFrame, by: str, parts: list[str], path: str) -> None:
    """A text for each row, in a folder by `by`; rows of a key are brought together first, so that it gets few files. Keys should be repositories or the like, not rows' ids."""
    df.select(by, F.concat_ws("\n\n", *parts).alias("text")).repartition(by).write.mode("overwrite").partitionBy(by).text(path)


def links(df: DataFrame, key: str, url, path: str) -> None:
    csv(df.select(key, url.alias("url")), path)


def status_back(sheet: DataFrame, results: DataFrame, key: str, columns: list[str], path: str) -> None:
    """A sheet with `columns` filled from results, written as CSV."""
    from perfloom.operators.joins import updated

    csv(updated(sheet, results, key, columns, key), path)
