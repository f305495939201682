"""Files in and out: raw captures, processed families, lookups and report tables."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from postlens import runtime
from postlens.functions import entities
from postlens.schemas import FAMILIES, RAW_POSTS, RAW_POSTS_FILE
from postlens.sources import commits

# Posts contain line breaks and quotes; blanks at their ends are kept.
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd HH:mm:ssXXX",
}


def csv_writer(df: DataFrame, mode: str = "errorifexists") -> DataFrameWriter:
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    return df.write.mode(mode).options(**options)


CORRUPT = "_corrupt"
CAPTURE_READER = {
    **CSV_OPTIONS,
    "pathGlobFilter": "*.csv",
    "recursiveFileLookup": "true",
    "columnNameOfCorruptRecord": CORRUPT,
    "columnPruning": "false",
}


def raw_text_schema(schema: T.StructType = RAW_POSTS_FILE) -> T.StructType:
    """All fields as text, so that nothing is lost before ``typed`` has looked at it."""
    return T.StructType([T.StructField(name, T.StringType()) for name in [*schema.fieldNames(), CORRUPT]])


def _instant(text):
    """An instant with its offset, or a plain day, which begins in UTC."""
    whole = F.lit(CSV_OPTIONS["timestampFormat"])
    return F.coalesce(F.try_to_timestamp(text, whole), F.try_to_timestamp(F.concat(text, F.lit(" 00:00:00+00:00")), whole))


def typed(rows: DataFrame, schema: T.StructType, rejects: str | None = None, mode: str = "append") -> DataFrame:
    """Rows of text with their types; ``capture`` stays if it is there.

    Rows that are torn, that hold a number, a date or a hashtag list which cannot
    be read, or that have no id or date, are never dropped in silence: they go to the
    Parquet folder ``rejects`` (by ``mode``), or without one the job fails. With a folder
    ``rows`` is read twice and should be staged.
    """
    readers = {T.LongType(): lambda c: c.try_cast("long"), T.TimestampType(): _instant}
    parsed = {f.name: readers[f.dataType](F.col(f.name)) if f.dataType in readers else F.col(f.name) for f in schema.fields}
    broken = F.col(CORRUPT).isNotNull() | F.col("id").isNull() | F.col("date").isNull()
    for field in schema.fields:
        if field.dataType in readers and field.name != "_row":
            broken = broken | (F.col(field.name).isNotNull() & parsed[field.name].isNull())
    broken = F.coalesce(broken | ~entities.readable_list(F.col("hashtags")), F.lit(True))
    names = [n for n in schema.fieldNames() if n != "_row"]
    kept = ["capture"] if "capture" in rows.columns else []
    if rejects is None:
        message = F.concat(F.lit("unreadable row, id "), F.coalesce("id", F.lit("missing")))
        good = rows.filter(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(True))
    else:
        rows.filter(broken).write.mode(mode).parquet(rejects)
        good = rows.filter(~broken)
    return good.select(*[parsed[n].alias(n) for n in names], *kept)


def read_raw(
    spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_POSTS_FILE, rejects: str | None = None, mode: str = "append"
) -> DataFrame:
    """Foreign capture files (CSV) without their row counter; ``capture`` is the file a post comes from.

    A file with line breaks inside its fields is one task's work; our own captures
    are Parquet, see ``read_captures``.
    """
    rows = spark.read.schema(raw_text_schema(schema)).options(**CAPTURE_READER).csv(path)
    rows = rows.withColumn("capture", F.col("_metadata.file_path"))
    if rejects is None:
        return runtime.spread(typed(rows, schema))
    return runtime.spread(typed(runtime.stage(rows, "raw-rows"), schema, rejects, mode))


def read_captures(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Posts as our own capture jobs store them, with the ``capture`` (keyword and window) of each."""
    schema = T.StructType([*RAW_POSTS.fields, T.StructField("capture", T.StringType())])
    paths = [path] if isinstance(path, str) else path
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)


def capture_files(spark: SparkSession, path: str, foreign: bool = False) -> list[str]:
    """The files that a folder of captures consists of."""
    if foreign:
        listed = spark.read.schema(raw_text_schema()).options(**CAPTURE_READER).csv(path)
    else:
        listed = read_captures(spark, path)
    return [unquote(x) for x in listed.inputFiles()]  # Spark names them as quoted addresses


def write_raw(raw: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Raw posts as capture files, with a leading row counter."""
    raw = raw.drop("capture")
    if partition_by:
        raw = raw.hint("rebalance", *partition_by)
    rows = raw.select(F.monotonically_increasing_id().alias("_row"), *raw.columns)
    writer = csv_writer(rows, mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, matched by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_families(frames: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Each processed table as Parquet below ``folder``, one sub-folder per month.

    Rebalancing gathers the rows of a month in a few files of even size, however
    large the month is.
    """
    for name, frame in frames.items():
        frame.hint("rebalance", "month").write.mode(mode).partitionBy("month").parquet(f"{folder}/{name}")


def read_family(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Everything written for one family so far; a missing column of an old file is null.

    A folder with manifests is read by these, see ``commits``.
    """
    schema = FAMILIES[name]
    if (found := commits.read(spark, folder, name, schema)) is not None:
        return found.select(*schema.fieldNames())
    return spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(f"{folder}/{name}").select(
        *schema.fieldNames()
    )


def union_files(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """One family out of several result folders, by column name."""
    return union_by_name([read_family(spark, folder, name) for folder in folders])


# The text columns in which a missing value counts as blank.
TEXT_COLUMNS = {
    "posts": ["content", "hashtags", "mentioned_usernames", "mentioned_display_names"],
    "hashtags": ["hashtags"],
    "hashtag_lists": ["hashtags"],
    "mentions": ["username", "display_name"],
    "mention_lists": ["username", "display_name"],
    "post_topics": ["content", "hashtags", "mentioned_usernames", "mentioned_display_names"],
}


def blank_fill(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The analysis tables with blanks for missing texts."""
    return {name: table.fillna("", TEXT_COLUMNS[name]) for name, table in tables.items()}


def load_text_tables(spark: SparkSession, folder: str, post_topics: str | None = None) -> dict[str, DataFrame]:
    """The five processed families, and the posts with topics if their folder is given, ready for analysis."""
    tables = {name: read_family(spark, folder, name) for name in FAMILIES}
    if post_topics is not None:
        tables["post_topics"] = spark.read.parquet(post_topics)
    return blank_fill(tables)


def read_class_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table of classified hashtags as CSV."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def report_tables(post_topics: DataFrame, hashtag_lists: DataFrame, mention_lists: DataFrame) -> dict[str, DataFrame]:
    """The three tables reporting tools read."""
    return {
        "posts": post_topics.drop("month", "mentioned_usernames", "mentioned_display_names", "hashtags"),
        "hashtags": hashtag_lists.select("id", "hashtags"),
        "mentions": mention_lists.select("id", "username", "display_name"),
    }


def write_report(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """CSV at the reporting edge."""
    for name, table in tables.items():
        csv_writer(table, mode).csv(f"{folder}/{name}")
