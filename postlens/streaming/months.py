"""Counts by calendar month over a stream, late rows included.

Months are tumbling windows of event time. Each batch of the stream is added up by month
and keys, and the sums are stored as one commit (see ``sources.commits``) together with
the watermark, the latest event time so far less the allowed delay. A month is *closed*
once the watermark has passed its end. Counts add up, so rows that come after
their month was closed are merged into it by storing one more sum, marked as late;
rows more than ``too_late`` behind the watermark stay out of the counts and are
stored apart, with their number for each month, instead of being dropped.

Spark's own watermark would drop late rows inside the operator without a trace; here the
state is the table of sums, as large as months x keys, which ``compact`` keeps short.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from postlens import runtime
from postlens.functions import scalars
from postlens.sources import commits

TABLES = ("counts", "too_late")


def _schema(keys: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("month", T.DateType()), *keys.fields, T.StructField("n", T.LongType()), T.StructField("late", T.BooleanType())])


def watermark(spark: SparkSession, folder: str) -> datetime.datetime | None:
    """The latest watermark that has been committed, in UTC."""
    found = [own["notes"]["watermark"] for own in commits.manifests(spark, folder) or [] if own["notes"].get("watermark")]
    return datetime.datetime.fromisoformat(max(found)) if found else None


def _micros(when: datetime.datetime) -> int:
    return (when - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)) // datetime.timedelta(microseconds=1)


def month_sums(rows: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """``month``, keys, ``n`` and the latest event time of each sum; rows without a time have a null month."""
    when = F.col(time).cast("timestamp")
    return rows.groupBy(scalars.month_start(when).alias("month"), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros(when)).alias("latest"))


def add_batch(
    rows: DataFrame, time: str, keys: list[str], folder: str, key: str, delay: datetime.timedelta, too_late: datetime.timedelta
) -> bool:
    """Store the sums of ``rows`` as commit ``key``; False if that is there already.

    Lateness is judged by the watermark from before this batch, so the rows of one batch do not
    make each other late, and a batch that is run again decides as before. Rows without a
    time are too late.
    """
    spark = rows.sparkSession
    before = watermark(spark, folder)
    sums = runtime.stage(month_sums(rows, time, keys), "month-sums")
    latest = sums.agg(F.max("latest")).first()[0]
    marks = [before] if before else []
    if latest is not None:
        marks.append(datetime.datetime.fromtimestamp(0, datetime.UTC) + datetime.timedelta(microseconds=latest) - delay)
    end = F.unix_date(F.add_months("month", 1)).cast("long") * 86_400_000_000
    late: Column = F.lit(False) if before is None else end <= F.lit(_micros(before))
    gone: Column = F.lit(False) if before is None else end <= F.lit(_micros(before - too_late))
    marked = sums.withColumn("late", late).withColumn("gone", F.col("month").isNull() | gone)
    columns = ["month", *keys, "n", "late"]
    tables = {"counts": marked.where("not gone").select(columns), "too_late": marked.where("gone").select(columns)}
    return commits.commit(spark, folder, key, tables, notes={"watermark": max(marks).isoformat() if marks else None})


def count_months(
    stream: DataFrame,
    time: str,
    keys: list[str],
    folder: str,
    checkpoint: str,
    delay: datetime.timedelta = datetime.timedelta(days=1),
    too_late: datetime.timedelta = datetime.timedelta(days=366),
) -> StreamingQuery:
    """Add everything that is new in ``stream`` to the months stored in ``folder``, then stop.

    A batch is named by the query of its checkpoint and its number there, so a run after a
    failure adds nothing twice.
    """

    def process(batch: DataFrame, number: int) -> None:
        with runtime.job_scratch(batch.sparkSession):
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            add_batch(batch, time, keys, folder, f"{query}-{number}", delay, too_late)

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def months(spark: SparkSession, folder: str, keys: T.StructType, closed_only: bool = False) -> DataFrame:
    """``month``, keys, ``n``, ``n_late`` (rows that came after the month was closed) and ``closed`` of all stored months."""
    names = keys.fieldNames()
    found = commits.read(spark, folder, "counts", _schema(keys))
    if found is None:
        found = spark.createDataFrame([], _schema(keys))
    mark = watermark(spark, folder)
    day = None if mark is None else mark.astimezone(datetime.UTC).date()
    sums = found.groupBy("month", *names).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("late"), F.col("n")).otherwise(0)).alias("n_late"))
    sums = sums.withColumn("closed", F.lit(False) if day is None else F.add_months("month", 1) <= F.lit(day))
    return sums.where("closed") if closed_only else sums


def too_late_rows(spark: SparkSession, folder: str, keys: T.StructType) -> DataFrame:
    """``month``, keys and ``n`` of the rows that stayed out of the months."""
    found = commits.read(spark, folder, "too_late", _schema(keys))
    if found is None:
        found = spark.createDataFrame([], _schema(keys))
    return found.groupBy("month", *keys.fieldNames()).agg(F.sum("n").alias("n"))


def compact(spark: SparkSession, folder: str, keys: T.StructType) -> None:
    """One commit in place of all: a row for each month, keys and lateness. Not while a batch is being added.

    The batches that it stands for stay known by their manifests, so none of them is added again.
    """
    earlier = commits.manifests(spark, folder)
    if not earlier or len(earlier) < 2:
        return
    names = keys.fieldNames()
    tables = {t: commits.read(spark, folder, t, _schema(keys)).groupBy("month", *names, "late").agg(F.sum("n").alias("n")).select("month", *names, "n", "late") for t in TABLES}
    mark = watermark(spark, folder)
    commits.commit(spark, folder, f"compact-{earlier[-1]['place']}", tables, replaces=True, notes={"watermark": mark.isoformat() if mark else None})
