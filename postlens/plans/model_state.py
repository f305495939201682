"""TF-IDF vocabularies kept month by month.

Document frequencies add up: those of all posts are the sums of those of each month. So a
month is counted once, when it comes, and stored as one commit (see ``sources.commits``); the
vocabulary of any set of months is a sum over the stored rows, from which the inverse
frequencies are derived last. A month is withdrawn by storing its counts once more
with the opposite sign. Adding or withdrawing a month reads nothing of the others.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from postlens import runtime
from postlens.operators import features
from postlens.sources import commits

FREQUENCIES = T.StructType(
    [T.StructField("month", T.DateType()), T.StructField("block", T.StringType()), T.StructField("token", T.StringType()), T.StructField("df", T.LongType())]
)
SIZES = T.StructType([T.StructField("month", T.DateType()), T.StructField("n", T.LongType())])


def stored_months(spark: SparkSession, folder: str) -> dict[datetime.date, int]:
    """The months that count, with their number of posts."""
    sizes = commits.read(spark, folder, "sizes", SIZES)
    if sizes is None:
        return {}
    # as short as the calendar
    return {r["month"]: r["n"] for r in sizes.groupBy("month").agg(F.sum("n").alias("n"), F.sum(F.signum("n")).alias("times")).where("times > 0").collect()}


def add_month(rows: DataFrame, month: datetime.date, folder: str, batch: str = "") -> bool:
    """Count the posts of one month (``contents``, ``mentions``, ``hashtags``) and store them; False if the month is there.

    All rows count as documents, also blank ones. A month that was withdrawn may be added
    again under another ``batch``; one that is stored has to be withdrawn first.
    """
    spark = rows.sparkSession
    key = f"add-{month.isoformat()}{batch and '-' + batch}"
    if month in stored_months(spark, folder):
        return False
    rows = runtime.stage(rows.select(*features.BLOCKS), "month-rows")
    tables = {
        "frequencies": features.document_frequencies(rows, []).select(F.lit(month).alias("month"), "block", "token", "df"),
        "sizes": rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(month).alias("month"), "n"),
    }
    return commits.commit(spark, folder, key, tables)


def withdraw_month(spark: SparkSession, month: datetime.date, folder: str) -> bool:
    """Take a stored month out of the sums; False if it is not there."""
    if month not in stored_months(spark, folder):
        return False
    adds = [own["key"] for own in commits.manifests(spark, folder) if own["key"].startswith(f"add-{month.isoformat()}")]
    path = f"commit={adds[-1]}"  # the rows that were added last are those that count
    frequencies = spark.read.schema(FREQUENCIES).parquet(f"{folder}/frequencies/{path}")
    sizes = spark.read.schema(SIZES).parquet(f"{folder}/sizes/{path}")
    tables = {"frequencies": frequencies.withColumn("df", -F.col("df")), "sizes": sizes.withColumn("n", -F.col("n"))}
    return commits.commit(spark, folder, f"withdraw-{adds[-1]}", tables)


def model(spark: SparkSession, folder: str, until: datetime.date | None = None, run: int = 0) -> features.TfIdf:
    """The vocabulary of all stored months, or of those before ``until``: the same as a fit on their posts."""
    frequencies, sizes = commits.read(spark, folder, "frequencies", FREQUENCIES), commits.read(spark, folder, "sizes", SIZES)
    if frequencies is None or sizes is None:
        raise ValueError(f"{folder}: no month is stored")
    if until is not None:
        frequencies, sizes = (t.where(F.col("month") < F.lit(until)) for t in (frequencies, sizes))
    counts = frequencies.groupBy("block", "token").agg(F.sum("df").alias("df")).where("df > 0").withColumn("run", F.lit(run))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("run", F.lit(run))
    return features.from_frequencies(counts, total.select("run", "n"))
