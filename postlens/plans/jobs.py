"""The jobs from folder to folder: what a scheduler would call."""

from __future__ import annotations

import datetime
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens import runtime
from postlens.operators import labels, ngrams, topics
from postlens.plans import enrich, model_runs
from postlens.schemas import RAW_VALIDATION_POSTS
from postlens.sources import capture, commits, files


def capture_months(
    archive: DataFrame, keyword: str, start: datetime.date, end: datetime.date, folder: str, **options
) -> None:
    """Store the captured posts as Parquet, one sub-folder per month window."""
    capture.write_capture(capture.capture_monthly(archive, keyword, start, end, **options), folder)


def capture_held_out(
    archive: DataFrame, keyword: str, folder: str, month: datetime.date = labels.HELD_OUT_MONTH, language: str | None = "en"
) -> None:
    """Store the posts of one month with their addresses; ``predict_month`` reads them."""
    after = datetime.date(month.year + (month.month == 12), month.month % 12 + 1, 1)
    capture.capture_window(archive, keyword, month, after, language).write.mode("overwrite").parquet(folder)


def process_files(
    spark: SparkSession,
    captures: str,
    lexicon: DataFrame,
    output: str,
    mode: str = "append",
    foreign: bool = False,
    rejects: str | None = None,
) -> None:
    """Clean the captured posts and add them to the five stored families, all five in one step.

    With ``append`` only capture files are read that no earlier run has taken in, so that the
    job may be run again at any time: after a failure, which leaves readers the state
    before, and when there are new captures. With ``overwrite`` all files are read and their
    posts replace what is stored. Either way nothing is written if there is nothing to do.

    ``foreign`` captures are CSV files; their unreadable rows go to ``rejects``, one
    folder per run, or without it the job fails.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"mode {mode}: append or overwrite")
    with runtime.job_scratch(spark):
        done = commits.committed_inputs(spark, output) if mode == "append" else set()
        new = sorted(set(files.capture_files(spark, captures, foreign)) - done)
        if not new:
            return
        # the same files in the same state give the same key: a run after a failure takes the place of the one that failed
        state = [own["key"] for own in (commits.manifests(spark, output) or [])[:1]]
        key = hashlib.sha256("\n".join([mode, *state, *new]).encode()).hexdigest()[:16]
        if mode == "overwrite":
            key = f"{key}-{uuid.uuid4().hex[:8]}"
        refused = None if rejects is None else f"{rejects}/commit={key}"
        raw = files.read_raw(spark, new, rejects=refused, mode="overwrite") if foreign else files.read_captures(spark, new)
        families = enrich.process_raw(raw, lexicon, staged=True)
        commits.commit(spark, output, key, families, new, "month", replaces=mode == "overwrite")


def assign_topics(spark: SparkSession, families: str, output: str, **options) -> None:
    """Fit the topic model on the stored posts and store them with their topics."""
    with runtime.job_scratch(spark):
        posts = files.load_text_tables(spark, families)["posts"]
        topics.post_topics(posts, **options).write.mode("overwrite").parquet(output)


def base_analysis(
    spark: SparkSession, families: str, post_topics: str, output: str, excluded_year: int | None = 2022
) -> None:
    """Write the n-gram tables, the collated table and the report tables as CSV."""
    with runtime.job_scratch(spark):
        tables = files.load_text_tables(spark, families, post_topics)
        counted = ngrams.monthly_ngrams(tables["posts"], tables["hashtags"], tables["mentions"], excluded_year)
        # written twice, counted once
        counted = runtime.stage(counted, "monthly-ngrams")
        parts = ["category", "ngram_type"]
        # the most frequent phrases come first in every file
        ordered = counted.hint("rebalance", *parts).sortWithinPartitions(*parts, F.desc("count"), "phrase")
        files.csv_writer(ordered, "overwrite").partitionBy(*parts).csv(f"{output}/ngrams")
        files.csv_writer(ngrams.collated_ngrams(counted), "overwrite").csv(f"{output}/collated_ngrams")
        report = files.report_tables(tables["post_topics"], tables["hashtag_lists"], tables["mention_lists"])
        files.write_report(report, output)


def label_stored_posts(
    spark: SparkSession, families: str, class_table: DataFrame, output: str, **rules
) -> None:
    """Store the labelled posts all model jobs start from."""
    with runtime.job_scratch(spark):
        posts = files.read_family(spark, families, "posts")
        lookup = labels.class_lookup(class_table)
        labels.label_posts(labels.model_rows(posts), lookup, **rules).write.mode("overwrite").parquet(output)


def evaluate_grid(spark: SparkSession, labelled: str, output: str, **grid) -> None:
    """Write keys, class distribution and class accuracy of the whole grid as CSV."""
    with runtime.job_scratch(spark):
        keys, shares, classes = model_runs.knn_grid(spark.read.parquet(labelled), **grid)
        files.write_report({"keys": keys, "category_distribution": shares, "prediction_accuracy": classes}, output)


def compare_methods(spark: SparkSession, labelled: str, output: str, samples: int | float = 10000, k: int = 7) -> None:
    """Write the outcome counts of the five methods, seen from both classes, as CSV."""
    with runtime.job_scratch(spark):
        survivor, other = model_runs.outcome_tables(spark.read.parquet(labelled), samples, k)
        files.write_report({"survivor": survivor, "other": other}, f"{output}/samples={samples}/k={k}")


def predict_month(
    spark: SparkSession,
    labelled: str,
    families: str,
    raw_validation: str,
    output: str,
    samples: int | float = 5000,
    k: int = 9,
    method: int = 0,
    month: datetime.date = labels.HELD_OUT_MONTH,
) -> None:
    """Write the predictions for the held-out month, with raw text and address, as CSV.

    ``raw_validation`` is a folder that ``capture_held_out`` has written.
    """
    with runtime.job_scratch(spark):
        posts = files.read_family(spark, families, "posts")
        validation = labels.model_rows(posts, training=False, month=month)
        raw = spark.read.schema(RAW_VALIDATION_POSTS).parquet(raw_validation)
        scored = model_runs.score_month(spark.read.parquet(labelled), validation, raw, samples, k, method)
        files.write_report({"predictions": scored}, output)
