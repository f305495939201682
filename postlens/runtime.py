"""Cluster concerns shared by all jobs: lineage cuts, staged tables, size checks."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# A side at or below this estimated size may be broadcast; above it the callers
# take their shuffled path.
BROADCAST_BYTES = 256 * 1024 * 1024

# Spark's setting that removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Reference dictionaries (lexicon, hashtag classes) up to this many rows are
# turned into literals; longer ones are joined.
DICTIONARY_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A throw-away local folder is only ever used with a local master, where the
    driver and the executors share one disk.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="postlens-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_JOB: contextvars.ContextVar[str] = contextvars.ContextVar("job", default="")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in the running job's own one if there is a job."""
    return f"{shared_folder(spark)}/postlens/{_JOB.get()}{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def job_scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes to a folder of its own, which is deleted at the end, also after a failure.

    Results must have been written before that.
    """
    if _JOB.get():  # part of a larger job
        yield
        return
    token = _JOB.set(f"job-{uuid.uuid4().hex}/")
    folder = f"{shared_folder(spark)}/postlens/{_JOB.get()}"
    try:
        yield
    finally:
        _JOB.reset(token)
        _delete(spark, folder)


def stage(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder, in files of ``rows_per_file`` rows at most (0: any), and read it back.

    Cuts the lineage, survives the loss of executors and, unlike a cached frame,
    still lets later reads prune columns. Nothing reads the shuffles behind it again, so
    their files go as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    kept = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, kept)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def unstage(staged: DataFrame) -> None:
    """Delete what ``stage`` has written; neither ``staged`` nor anything made of it may be read again."""
    _delete(staged.sparkSession, staged.staged_path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def number_rows(df: DataFrame, name: str, label: str) -> DataFrame:
    """``df``, staged, with a unique number per row.

    The numbers are part of the staged table, so they stay the same however
    often and with however many splits it is read.
    """
    return stage(df.withColumn(name, F.monotonically_increasing_id()), label)


def spread(scan: DataFrame) -> DataFrame:
    """A freshly read table on at least as many partitions as there are cores.

    Only input of fewer splits than cores is moved, so large tables stay as they
    are. For plain scans: counting the splits of a shuffled frame would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row of ``df`` as a broadcast would hold it."""
    row = F.lit(16)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            row = row + F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
        else:
            row = row + F.lit(8)
    return row.cast("long")


def byte_size(df: DataFrame) -> int:
    """Size of the rows in bytes as a broadcast would hold them (one aggregate over ``df``)."""
    return df.agg(F.sum(row_bytes(df)).alias("bytes")).first()["bytes"] or 0


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df``, which should be staged already, is small enough to broadcast."""
    return byte_size(df) <= (BROADCAST_BYTES if limit is None else limit)


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its checked size allows it, else unchanged."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Inner join with ``right``, whose ``keys`` are unique, whatever their frequencies in ``left``.

    A small enough ``right`` is broadcast. Else the keys that hold more than one
    partition's share of ``left`` (fewer than there are partitions) are counted
    first; their rows meet a broadcast of those keys, all others are shuffled.
    ``left`` is read three times then and should be staged.
    """
    if fits_broadcast(right, limit):
        return left.join(F.broadcast(right), keys)
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = left.groupBy(*keys).count()
    total = left.count()
    hot = stage(counts.filter(F.col("count") * width > total).select(*keys), "hot-keys")
    few = stage(right.join(F.broadcast(hot), keys, "left_semi"), "hot-rows")
    often = left.join(F.broadcast(few), keys)
    return left.join(F.broadcast(hot), keys, "left_anti").join(right, keys).unionByName(often)
