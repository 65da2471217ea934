"""Reading tables, the shared folder for checkpoints, and joins that hot keys and growing tables can't break."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType

#: What is broadcast has at most this size, as counted beforehand; beyond it Spark joins by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Keys with more than this share of a table's rows are hot. There can't be more than its inverse of them.
HOT_SHARE = 1 / 2_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name`; only Spark's own reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() usable with the folder that spark.checkpoint.dir names.

    Where none is named, a local session (a test) gets a temporary one; on a cluster that is an error, since a folder of
    one machine is lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def stored(df: DataFrame) -> DataFrame:
    """`df`, written as a table in the shared folder and read back: it cuts lineage, and later readers take only their columns."""
    spark = df.sparkSession
    checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the table of a `stored` DataFrame that nothing will read again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("table-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def _flat(df: DataFrame) -> int | None:
    """The bytes of a row whose columns have fixed sizes, with what a hash table adds to it; None if they have not."""
    kinds = [f.dataType for f in df.schema.fields]
    return None if any(not isinstance(k, AtomicType) or isinstance(k, (StringType, BinaryType)) for k in kinds) else 32 + 16 * len(kinds)


def bounded(df: DataFrame) -> DataFrame:
    """`df`, which should be checkpointed, marked for broadcast if it is counted to be small.

    Rows of variable size are measured as JSON text, which is longer than their binary form.
    """
    width = _flat(df)
    if width is not None:
        size = df.count() * width
    else:
        size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", grows: bool = False) -> DataFrame:
    """`rows` joined with `keyed`, one row for each key, whose column `count` has the number of `rows` with that key.

    Rows with a hot key don't meet in one task: the few hot keys are broadcast, and only the others are shuffled. `how`
    is inner or left. Both sides should be checkpointed, as they are read twice. A `keyed` that grows with the data is not
    even tried as a broadcast.
    """
    hot = F.col(count) > max(1.0, total * HOT_SHARE)
    few = F.broadcast(keyed.where(hot).drop(count))
    cold = rows.join(F.broadcast(keyed.where(hot).select(*keys)), keys, "left_anti")
    rest = keyed.where(~hot).drop(count)
    return rows.join(few, keys).unionByName(cold.join(rest if grows else bounded(rest), keys, how))


def sampled(df: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows of `df` with the smallest hashes of `key`.

    Rows are counted first, and those whose hash is out of reach are left out, so that tasks don't send n rows each.
    """
    total = df.count()
    width = 1 << 40
    h = F.pmod(F.xxhash64(key), F.lit(width))
    if total > 4 * n:
        # Twice as many as needed are expected: that fewer than n come is out of the question for the sizes used.
        df = df.where(h < int(width * (2 * n + 50) / total))
    return df.orderBy(h, key).limit(n)


_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for Arrow batches to 8 MB: executors and workers hold several of them at a time."""
    now = spark.conf.get(_BATCH, None)
    if now is None or not now.lower().rstrip("b").isdigit() or not 0 < int(now.lower().rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Short pieces of Arrow batches, each with its texts as UTF-8 (null: empty), so that a worker holds little at a time.

    A piece has at most `limit` bytes, or one row.
    """
    for batch in batches:
        texts, start, size = [], 0, 0
        for i, x in enumerate(batch.column(column)):
            t = x.as_buffer().to_pybytes() if x.is_valid else b""
            if texts and size + len(t) > limit:
                yield batch.slice(start, i - start), texts
                texts, start, size = [], i, 0
            texts.append(t)
            size += len(t)
        if texts:
            yield batch.slice(start), texts


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the job that wrote them has ended, which is right where every step ends in a checkpoint.

    If an executor is lost, its tasks run again from the last checkpoint. The setting is the session's: a query that
    runs at the same time in the same session and reads a shuffle again later recomputes it, which costs time and
    changes no result. Sessions that share a context (newSession) have settings of their own.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
