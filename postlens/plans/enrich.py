"""From raw posts to the five processed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlens import runtime
from postlens.functions import scalars, text
from postlens.operators import entities
from postlens.operators.sentiment import add_sentiment
from postlens.schemas import FAMILIES


def clean_posts(raw: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Cleaned content, day and month, sentiment; entity columns still as captured."""
    dated = raw.withColumns(
        {
            "date": scalars.day(F.col("date")),
            "month": scalars.month_start(F.col("date")),
            "_words": text.clean_words(F.col("content")),
        }
    )
    scored = add_sentiment(dated, F.col("_words"), lexicon)
    return scored.withColumn("content", F.array_join("_words", " ")).drop("_words")


def process_raw(raw: DataFrame, lexicon: DataFrame, staged: bool = False) -> dict[str, DataFrame]:
    """The five families: posts, mentions, mention_lists, hashtags, hashtag_lists.

    ``staged`` writes the cleaned posts to the shared folder first; worth it when
    more than one family is used, as the texts are then cleaned only once. Posts are
    merged with their entities within their ``capture``; without that column all
    are one capture.
    """
    base = clean_posts(raw, lexicon)
    if staged:
        base = runtime.stage(base, "clean-posts")
    mentions = entities.parsed_mentions(base)
    hashtags = entities.parsed_hashtags(base)
    frames = {
        "posts": entities.merge_entities(base),
        "mentions": entities.mention_strings(mentions),
        "mention_lists": entities.mention_lists(mentions),
        "hashtags": entities.hashtag_strings(hashtags),
        "hashtag_lists": entities.hashtag_lists(hashtags),
    }
    return {name: frame.select(*FAMILIES[name].fieldNames()) for name, frame in frames.items()}
