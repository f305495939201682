"""Lexicon sentiment: the mean polarity and subjectivity of the known words of a post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from postlens import runtime
from postlens.functions import scalars
from postlens.operators.dictionary import word_sums

# Lexicon scores are summed as whole millionths, so the result does not depend
# on the order in which they are added.
MICRO = 1_000_000

# Negations that are left after the stopwords are gone.
NEGATIONS = ("never",)


def _scaled(lexicon: DataFrame) -> DataFrame:
    """The lexicon in millionths, one row per word: the mean of its senses."""
    missing = {"polarity": 0.0, "subjectivity": 0.0, "intensity": 1.0}
    means = lexicon.groupBy("word").agg(*[F.avg(score).alias(score) for score in missing]).fillna(missing)
    return means.select(
        "word",
        *[F.rint(F.col(score) * MICRO).cast("long").alias(f"_{score}") for score in missing],
        F.lit(1).cast("long").alias("_known"),
    )


def _with_means(summed: DataFrame) -> DataFrame:
    """Scores out of the summed millionths and the number of known words."""

    def mean(total: str) -> Column:
        return F.when(F.col("_known") > 0, F.col(total) / (F.lit(float(MICRO)) * F.col("_known"))).otherwise(0.0)

    return (
        summed.withColumn("sentiment", mean("_polarity"))
        .withColumn("polarity", scalars.polarity_label(F.col("sentiment")))
        .withColumn("subjectivity", mean("_subjectivity"))
        .drop("_polarity", "_subjectivity", "_known")
    )


def add_sentiment(
    df: DataFrame, words: Column, lexicon: DataFrame, max_rows: int | None = None
) -> DataFrame:
    """Append ``sentiment``, ``polarity`` (its label) and ``subjectivity``; no hit scores 0."""
    weights = ["_polarity", "_subjectivity", "_known"]
    return _with_means(word_sums(df, words, _scaled(lexicon), "word", weights, max_rows))


def add_modified_sentiment(
    df: DataFrame, words: Column, lexicon: DataFrame, negations: tuple[str, ...] = NEGATIONS
) -> DataFrame:
    """``add_sentiment`` in which words change the known word right after them.

    A known word of an intensity other than 1 multiplies both scores of the next
    one, within -1 and 1, and is not counted itself. A negation in front of a
    word, or of its modifier, turns its polarity around and halves it; in front
    of a modifier it also inverts the intensity.
    """
    spark = df.sparkSession
    rows = runtime.number_rows(df.withColumn("_words", words), "_row", "sentiment-rows")
    known = _scaled(lexicon)
    # a handful of words
    unknown = F.broadcast(spark.createDataFrame([(w,) for w in negations], "word string")).join(
        known, "word", "left_anti"
    )
    zero = F.lit(0).cast("long")
    entries = known.unionByName(
        unknown.select(
            "word", zero.alias("_polarity"), zero.alias("_subjectivity"),
            F.lit(MICRO).cast("long").alias("_intensity"), zero.alias("_known"),
        )
    ).withColumn("_negation", F.col("word").isin(list(negations)))
    entries = runtime.small_side(runtime.stage(entries, "sentiment-words"))

    hits = rows.select("_row", F.posexplode("_words").alias("_at", "word")).join(entries, "word")
    modifier = (F.col("_known") == 1) & (F.col("_intensity") != MICRO)
    facts = F.struct("_at", "_intensity", "_negation", modifier.alias("modifier"), (F.col("_known") == 1).alias("known"))
    # a window holds one post
    order = Window.partitionBy("_row").orderBy("_at")
    near = hits.select(
        "_row", "_at", "_polarity", "_subjectivity", "_known", modifier.alias("_modifier"),
        F.lag(facts, 1).over(order).alias("_p"),
        F.lag(facts, 2).over(order).alias("_pp"),
        F.lead(facts, 1).over(order).alias("_n"),
    )

    def yes(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    adjacent = F.col("_p._at") == F.col("_at") - 1
    modified = yes(adjacent & F.col("_p.modifier"))
    inverted = modified & yes((F.col("_pp._at") == F.col("_at") - 2) & F.col("_pp._negation"))
    negated = inverted | yes(adjacent & F.col("_p._negation"))
    absorbed = F.col("_modifier") & yes((F.col("_n._at") == F.col("_at") + 1) & F.col("_n.known"))

    strength = F.col("_p._intensity") / F.lit(float(MICRO))
    factor = F.when(inverted, 1.0 / strength).when(modified, strength).otherwise(1.0)

    def changed(score: str) -> Column:
        return F.greatest(F.least(F.rint(F.col(score) * factor), F.lit(float(MICRO))), F.lit(-float(MICRO)))

    counted = near.filter((F.col("_known") == 1) & ~absorbed).select(
        "_row",
        F.when(negated, F.rint(changed("_polarity") * -0.5)).otherwise(changed("_polarity")).cast("long").alias("_polarity"),
        changed("_subjectivity").cast("long").alias("_subjectivity"),
        "_known",
    )
    totals = ["_polarity", "_subjectivity", "_known"]
    sums = counted.groupBy("_row").agg(*[F.sum(name).alias(name) for name in totals])
    return _with_means(rows.join(sums, "_row", "left").fillna(0, totals)).drop("_words", "_row")
