"""Model rows and the class labels that classified hashtags give them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from postlens.functions import scalars
from postlens.operators.dictionary import word_sums

# Class flag column -> class name, in tie-breaking order.
CLASSES = {
    "domestic_violence": "Domestic Violence",
    "politics": "Politics",
    "health": "Health",
}
SURVIVOR = "Victim/Survivor"
OTHER = "Other"
HELD_OUT_MONTH = datetime.date(2022, 1, 1)


def model_rows(posts: DataFrame, training: bool = True, month: datetime.date = HELD_OUT_MONTH) -> DataFrame:
    """Posts before (``training``) or of the held-out month, ready for the vectorisers.

    Posts without words are left out; both scores are rounded to two places.
    """
    held_out = F.col("month").eqNullSafe(F.lit(month))
    rows = posts.filter(~held_out if training else held_out)
    rows = rows.filter(F.col("content").isNotNull() & (F.col("content") != ""))
    names = ["id"] if training else ["id", "username"]
    return rows.select(
        *names,
        F.col("content").alias("contents"),
        scalars.round_half_even(F.col("sentiment")).alias("sentiment"),
        scalars.round_half_even(F.col("subjectivity")).alias("subjectivity"),
        F.coalesce("mentioned_usernames", F.lit("")).alias("mentions"),
        F.coalesce("hashtags", F.lit("")).alias("hashtags"),
    )


def class_lookup(table: DataFrame) -> DataFrame:
    """The phrases that carry at least one class flag."""
    flags = [c for c in table.columns if c not in ("row", "phrase", "count")]
    total = sum((F.coalesce(F.col(flag), F.lit(0)) for flag in flags), F.lit(0))
    return table.filter(total > 0)


def hashtag_weights(lookup: DataFrame) -> DataFrame:
    """One row per phrase: ``count`` for each class it belongs to, and the survivor flag.

    Of a repeated phrase the last row sets the weights, a blank count there too (it
    takes the phrase out); any row may set the flag.
    """
    weights = {name: F.col("count") * F.col(name) for name in CLASSES}
    return lookup.groupBy("phrase").agg(
        F.max(F.when(F.col("survivor") == 1, 1).otherwise(0)).cast("long").alias("survivor"),
        *[
            F.coalesce(F.max_by(weight, F.col("row")), F.lit(0)).alias(name)
            for name, weight in weights.items()
        ],
    )


def add_hashtag_weights(rows: DataFrame, lookup: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Append the number of survivor tags and the summed weight of each class."""
    tags = F.split(F.col("hashtags"), " ")
    return word_sums(rows, tags, hashtag_weights(lookup), "phrase", ["survivor", *CLASSES], max_rows)


def largest_category(weights: list[str] | None = None):
    """Name of the class with the largest weight; the first one wins ties."""
    names = list(CLASSES) if weights is None else weights
    top = F.greatest(*[F.col(n) for n in names])
    label = F.lit(None).cast("string")
    for name in reversed(names):
        label = F.when(F.col(name) == top, F.lit(CLASSES[name])).otherwise(label)
    return label


def label_posts(
    rows: DataFrame,
    lookup: DataFrame,
    several_survivor_tags: bool = False,
    count_last_class: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Append ``category`` and drop the rows no class speaks for.

    By default the last class alone does not keep a row, and only exactly one
    survivor tag makes a survivor post; the two flags lift these rules.
    """
    weighted = add_hashtag_weights(rows, lookup, max_rows)
    counted = list(CLASSES) if count_last_class else list(CLASSES)[:-1]
    kept = weighted.filter(sum((F.col(c) for c in counted), F.lit(0)) > 0)
    is_survivor = F.col("survivor") >= 1 if several_survivor_tags else F.col("survivor") == 1
    category = F.when(is_survivor, SURVIVOR).otherwise(largest_category())
    return kept.withColumn("category", category).drop("survivor", *CLASSES)
