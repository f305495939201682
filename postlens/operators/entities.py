"""Mention and hashtag tables, and their merge into the posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlens import runtime
from postlens.functions import entities

ENTITY_BASE = [
    "id", "date", "month", "reply_count", "retweet_count", "like_count", "quote_count",
    "sentiment", "polarity", "subjectivity",
]


def _kept(posts: DataFrame) -> list[str]:
    return [*ENTITY_BASE, "capture"] if "capture" in posts.columns else ENTITY_BASE


def _keys(posts: DataFrame) -> list[str]:
    """What names a post: its id, within its capture where captures are told apart."""
    return ["capture", "id"] if "capture" in posts.columns else ["id"]


def parsed_mentions(posts: DataFrame) -> DataFrame:
    """One row per post with a mention list; both names as arrays."""
    return posts.filter(F.col("mentioned_users").isNotNull()).select(
        *_kept(posts),
        entities.mention_usernames(F.col("mentioned_users")).alias("username"),
        entities.mention_display_names(F.col("mentioned_users")).alias("display_name"),
    )


def mention_strings(parsed: DataFrame) -> DataFrame:
    return parsed.withColumns(
        {
            "username": entities.joined(F.col("username")),
            "display_name": entities.joined(F.col("display_name")),
        }
    )


def mention_lists(parsed: DataFrame) -> DataFrame:
    """One row per mention; an empty list keeps one row of nulls."""
    pairs = F.explode_outer(F.arrays_zip(F.col("username"), F.col("display_name"))).alias("_pair")
    return parsed.select(*_kept(parsed), pairs).select(
        *_kept(parsed), F.col("_pair.username"), F.col("_pair.display_name")
    )


def parsed_hashtags(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("hashtags").isNotNull()).select(
        *_kept(posts), entities.hashtag_array(F.col("hashtags")).alias("hashtags")
    )


def hashtag_strings(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("hashtags", entities.joined_lower(F.col("hashtags")))


def hashtag_lists(parsed: DataFrame) -> DataFrame:
    """One row per hashtag, as ``#tag`` in lower case."""
    tags = F.explode(F.transform(F.col("hashtags"), entities.tag_label)).alias("hashtags")
    return parsed.select(*_kept(parsed), tags)


def join_mentions(posts: DataFrame, mentions: DataFrame) -> DataFrame:
    """Left join of the mention strings within a capture; repeated ids multiply rows."""
    names = mentions.select(
        *_keys(posts),
        F.col("username").alias("mentioned_usernames"),
        F.col("display_name").alias("mentioned_display_names"),
    )
    return posts.join(names, _keys(posts), "left")


def join_hashtags(posts: DataFrame, hashtags: DataFrame) -> DataFrame:
    """Left join of the hashtag strings within a capture; repeated ids multiply rows."""
    return posts.join(hashtags.select(*_keys(posts), "hashtags"), _keys(posts), "left")


def merge_entities(posts: DataFrame, limit: int | None = None) -> DataFrame:
    """Posts with their own mention and hashtag strings, as the two left joins give them.

    The joins only matter for ids that occur more than once in a capture, where every
    copy meets the entities of every other copy. Single posts take their strings from
    their own row, so just the ids are shuffled, not the posts. Should repeated
    ids be too many to broadcast, the joins run on all rows.
    """
    bare = posts.drop("mentioned_users", "hashtags")
    mentions = mention_strings(parsed_mentions(posts))
    hashtags = hashtag_strings(parsed_hashtags(posts))

    keys = _keys(posts)
    repeated = posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(*keys)
    repeated = runtime.stage(repeated, "repeated-ids")
    size = runtime.byte_size(repeated)
    if size > (runtime.BROADCAST_BYTES if limit is None else limit):
        return join_hashtags(join_mentions(bare, mentions), hashtags)

    own = posts.join(F.broadcast(repeated), keys, "left_anti").withColumns(
        {
            "mentioned_usernames": entities.joined(entities.mention_usernames(F.col("mentioned_users"))),
            "mentioned_display_names": entities.joined(
                entities.mention_display_names(F.col("mentioned_users"))
            ),
            "hashtags": entities.joined_lower(entities.hashtag_array(F.col("hashtags"))),
        }
    ).drop("mentioned_users")
    if size == 0:
        return own

    def copies(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(repeated), keys, "left_semi")

    joined = join_hashtags(join_mentions(copies(bare), copies(mentions)), copies(hashtags))
    return own.unionByName(joined)
