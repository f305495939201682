"""Posts and lookup tables that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens import runtime
from postlens.functions import text
from postlens.operators.ngrams import ngram_counts
from postlens.schemas import HASHTAG_CLASSES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return runtime.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts with language and address, one per document, over 13 months."""
    doc, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")
    key = doc.cast("string")
    content = F.when(doc % 25 == 3, "").otherwise(
        F.concat(
            F.col("text"), F.lit(" &amp; @"), source, F.lit(" #Tag_"), lang,
            F.lit(" https://x.io/"), key, F.lit(" foo.com/a bar.com"),
        )
    )
    users = F.when(
        doc % 3 != 0,
        F.concat(
            F.lit("[User(username='"), source, F.lit("', id="), key,
            F.lit(", displayname='Name "), source, F.lit("', description=None), User(username='"), lang,
            F.lit("_desk', id=1, displayname='"), lang, F.lit("', description=None)]"),
        ),
    )
    tags = F.when(
        doc % 4 != 0,
        F.concat(
            F.lit("['"), F.upper(lang), F.lit("', '"), source, F.lit("'"),
            F.when(doc % 5 == 1, ", 'MeToo'").otherwise(""),
            F.when(doc % 10 == 1, ", 'WhyIStayed'").otherwise(""),
            F.lit("]"),
        ),
    )
    return table(spark, sf_dir, "documents").select(
        doc.alias("id"),
        F.date_add(F.lit("2021-01-01").cast("date"), ((doc * 7) % 396).cast("int")).cast("timestamp").alias("date"),
        source.alias("username"),
        F.concat(F.lit("Name "), source).alias("display_name"),
        content.alias("content"),
        (doc % 7).alias("reply_count"),
        (doc % 5).alias("retweet_count"),
        (doc % 11).alias("like_count"),
        (doc % 3).alias("quote_count"),
        users.alias("mentioned_users"),
        tags.alias("hashtags"),
        lang.alias("lang"),
        F.concat(F.lit("https://x.io/"), key).alias("url"),
    )


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark, sf_dir).drop("lang", "url")


def captured_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of two captures with all that makes them awkward.

    Null contents, names without quotes, with a comma and in double quotes, hashtags
    with escapes, posts that both captures hold, and posts twice in one capture.
    """
    posts, key, lang = archive(spark, sf_dir), F.col("id"), F.col("lang")
    users = F.concat(
        F.lit("[User(username='plain', id=1, displayname=None, description=None), User(username='"), lang,
        F.lit("', id=2, displayname='Last, First', description=None), "),
        F.lit("User(username='q', id=3, displayname=\"O'Hara\", description=None)]"),
    )
    posts = posts.withColumns(
        {
            "content": F.when(F.col("content") != "", F.col("content")),
            "mentioned_users": F.when(key % 11 == 5, users).otherwise(F.col("mentioned_users")),
            "hashtags": F.when(key % 13 == 4, "['ok', 'a\\xa0b', \"it's\"]").otherwise(F.col("hashtags")),
            "capture": F.lit("a"),
        }
    ).drop("lang", "url")
    both = posts.filter(key % 10 == 0).withColumn("capture", F.lit("b"))
    twice = posts.filter(key % 15 == 1).withColumns({"hashtags": F.lit("['again']"), "like_count": F.col("like_count") + 100})
    return posts.unionByName(both).unionByName(twice)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invented lexicon: the words of the benchmark texts, scored by their hash."""
    word = F.explode(text.clean_words(F.col("text"))).alias("word")
    words = table(spark, sf_dir, "benchmark").select(word).distinct()

    def draw(first: int, steps: int):
        digits = F.substring(F.md5("word"), first, 4)
        return (F.conv(digits, 16, 10).cast("int") % steps).cast("double")

    return words.select(
        "word",
        ((draw(1, 21) - 10) / 10).alias("polarity"),
        (draw(5, 11) / 10).alias("subjectivity"),
        F.when(draw(9, 10) == 0, 1.3).when(draw(9, 10) == 1, 0.5).otherwise(1.0).alias("intensity"),
    )


# phrase: survivor, domestic_violence, politics, health
FLAGS = {
    "metoo": (1, 1, 0, 0),
    "whyistayed": (1, 0, 0, 0),
    "es": (0, 1, 0, 0),
    "de": (0, 0, 1, 0),
    "fr": (0, 0, 0, 1),
    **{f"src{i}": (0, 1, 0, 0) for i in range(0, 20, 4)},
    **{f"src{i}": (0, 0, 1, 0) for i in range(1, 20, 4)},
    **{f"src{i}": (0, 0, 0, 1) for i in range(2, 20, 4)},
}
FLAG_NAMES = ["survivor", "domestic_violence", "politics", "health"]
# listed a second time, further down, with half the count, or with none
REPEATED, BLANKED = "src1", "src8"

EXCLUSIONS = ["que", "zzzz"]

# frequent words of the texts, taken for negations
NEGATIONS = ("er", "que")


def hashtag_classes(spark: SparkSession, posts: DataFrame) -> DataFrame:
    """The counted hashtags of the posts, some of them classified, one listed twice."""
    counted = ngram_counts(posts.filter(F.col("hashtags").isNotNull()), "hashtags")
    flags = spark.createDataFrame(
        [(phrase, *values) for phrase, values in FLAGS.items()],
        "phrase string, " + ", ".join(f"{name} int" for name in FLAG_NAMES),
    )
    table = counted.join(F.broadcast(flags), "phrase", "left").fillna(0, FLAG_NAMES)
    again = table.filter(F.col("phrase") == REPEATED).withColumn("count", F.floor(F.col("count") / 2))
    blank = table.filter(F.col("phrase") == BLANKED).withColumn("count", F.lit(None).cast("long"))
    rows = table.withColumn("row", F.lit(1)).unionByName(again.unionByName(blank).withColumn("row", F.lit(2)))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HASHTAG_CLASSES])


def exclusions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in EXCLUSIONS], "phrase string")


def with_topic(posts: DataFrame) -> DataFrame:
    """Posts with a given topic; the last one has no label."""
    return posts.withColumn("topic", (F.col("id") % 10).cast("int"))


def topic_labels(spark: SparkSession) -> DataFrame:
    return spark.range(9).select(
        F.col("id").cast("int").alias("topic"), F.concat(F.lit("topic "), F.col("id")).alias("topic_label")
    )


def predictions(labelled: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled posts with a prediction that the labels table makes right or wrong."""
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    guess = (
        F.when(F.col("toxic") == 1, "Victim/Survivor")
        .when(F.col("quality") == 0, "Other")
        .otherwise(F.col("category"))
    )
    return labelled.join(judged, "id", "left").select("id", F.col("category").alias("actual"), guess.alias("prediction"))
