"""Incremental processing of capture files dropped into an inbox folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postlens import runtime
from postlens.plans.enrich import process_raw
from postlens.schemas import RAW_POSTS_FILE
from postlens.sources import commits
from postlens.sources.files import CAPTURE_READER, raw_text_schema, read_family, typed


def ingest_inbox(
    spark: SparkSession,
    inbox: str,
    lexicon: DataFrame,
    output: str,
    checkpoint: str,
    archive: str | None = None,
    max_files: int | None = None,
    rejects: str | None = None,
) -> StreamingQuery:
    """Process every CSV file of ``inbox`` and its sub-folders that has not been processed yet, then stop.

    Each file is a capture of its own, so it makes no difference which files come
    together in a batch. Rows that cannot be read go to ``rejects``, one folder per
    batch, or without it the batch fails.

    The checkpoint knows which files are done; moving them to ``archive`` is
    best effort and lags behind. A batch shows in all five tables at once, when its manifest is
    written (see ``commits``). It is named by the query of the checkpoint and its number there,
    so one that is run again after a failure replaces what it has left, refused rows
    included, or is passed over if it had been committed.
    """
    reader = spark.readStream.schema(raw_text_schema(RAW_POSTS_FILE)).options(**CAPTURE_READER)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def process(batch: DataFrame, batch_id: int) -> None:
        # five tables are written from the batch; its files are parsed once
        with runtime.job_scratch(batch.sparkSession):
            own = batch.sparkSession
            key = f"{own.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
            if rejects is None:
                rows = typed(batch, RAW_POSTS_FILE)
            else:
                rows = typed(runtime.stage(batch, "inbox-rows"), RAW_POSTS_FILE, f"{rejects}/commit={key}", "overwrite")
            commits.commit(own, output, key, process_raw(rows, lexicon, staged=True), partition_by="month")

    return (
        reader.csv(inbox)
        .withColumn("capture", F.col("_metadata.file_path"))
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def processed(spark: SparkSession, output: str, name: str) -> DataFrame:
    """Everything the inbox job has written for one family."""
    return read_family(spark, output, name)
