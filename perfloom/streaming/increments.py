"""Increments with Structured Streaming: only new records, and only work whose result is missing or out of date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, path: str, schema: str, time: str = "ts") -> DataFrame:
    """A stream of Parquet files with an event time that can carry a watermark."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """The first record of each key; keys are forgotten when the watermark has passed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, by: list[str], delay: str = "1 day") -> DataFrame:
    """Counts by tumbling window; records later than the watermark are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def append_new(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come since the last run, and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def pending(tasks: DataFrame, results: DataFrame, key: str, text: str) -> DataFrame:
    """Tasks without a result for the same text."""
    stamp = lambda df: df.withColumn("_h", F.sha2(F.coalesce(text, F.lit("")), 256))
    return stamp(tasks).join(stamp(results).select(key, "_h"), [key, "_h"], "left_anti").drop("_h")


def append_unseen(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Appends records whose keys no run before has seen, and ends. Which keys were seen is the query's state, kept in `checkpoint`.

    The state has a row for each key, spread over the shuffle's partitions; a run that was stopped goes on where it was.
    """
    return append_new(stream.dropDuplicates(keys), path, checkpoint)


class Results:
    """Results of tasks, merged batch by batch: of each key and text the newest one by `order`.

    Rows are spread over `buckets` by their key. A batch writes the buckets that it touches anew, as the version of its
    number, from the newest version before it; so a batch that comes again writes the same again, and nothing changes. The
    newest version of a bucket is what counts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, text: str, order: str, buckets: int = 16):
        self.spark, self.path, self.schema = spark, path, schema
        self.key, self.text, self.order, self.buckets = key, text, order, buckets

    def _versions(self, before: int | None = None) -> DataFrame:
        """Rows of the newest version of each bucket, of those before a batch if one is given, with `_bucket`."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{self.schema}, _hash string, _bucket int")
        rows = self.spark.read.schema(f"{self.schema}, _hash string, _version long, _bucket int").parquet(self.path)
        rows = rows if before is None else rows.where(F.col("_version") < before)
        newest = rows.groupBy("_bucket").agg(F.max("_version").alias("_version"))
        # A row for each bucket.
        return rows.join(F.broadcast(newest), ["_bucket", "_version"]).drop("_version")

    def read(self) -> DataFrame:
        return self._versions().drop("_bucket", "_hash")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merges a batch; rows with a null key are left out."""
        stamped = batch.where(F.col(self.key).isNotNull()).withColumn("_hash", F.sha2(F.coalesce(self.text, F.lit("")), 256))
        new = stamped.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = new.select("_bucket").distinct()
            old = self._versions(number).join(F.broadcast(touched), "_bucket", "left_semi")
            both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            columns = [c for c in both.columns if c not in ("_bucket", "_new")]
            best = both.groupBy("_bucket", F.col(self.key).alias("_k"), F.col("_hash").alias("_h")).agg(F.max_by(F.struct(*columns), F.struct(F.col(self.order), F.col("_new"), *[F.col(c) for c in columns])).alias("_row"))
            best.select("_bucket", "_row.*").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/_version={number}")
        finally:
            new.unpersist()

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merges what has come since the last run, and ends."""
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def pending(self, tasks: DataFrame) -> DataFrame:
        """Tasks without a result for their text as it is now."""
        return pending(tasks, self.read(), self.key, self.text)
