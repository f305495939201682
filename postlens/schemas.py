"""Fixed table schemas; no stage infers types."""

from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_POSTS = _schema(
    "id long, date timestamp, username string, display_name string, content string, "
    "reply_count long, retweet_count long, like_count long, quote_count long, "
    "mentioned_users string, hashtags string"
)

RAW_VALIDATION_POSTS = T.StructType(RAW_POSTS.fields + [T.StructField("url", T.StringType())])

# The monthly capture files carry an unnamed leading row counter.
RAW_POSTS_FILE = T.StructType([T.StructField("_row", T.LongType())] + RAW_POSTS.fields)

POSTS = _schema(
    "id long, date date, month date, username string, display_name string, content string, "
    "reply_count long, retweet_count long, like_count long, quote_count long, "
    "sentiment double, polarity string, subjectivity double, "
    "mentioned_usernames string, mentioned_display_names string, hashtags string"
)

_ENTITY_BASE = (
    "id long, date date, month date, reply_count long, retweet_count long, like_count long, "
    "quote_count long, sentiment double, polarity string, subjectivity double, "
)

MENTIONS = _schema(_ENTITY_BASE + "username string, display_name string")
HASHTAGS = _schema(_ENTITY_BASE + "hashtags string")

# The five families written for every processed batch of posts.
FAMILIES = {
    "posts": POSTS,
    "mentions": MENTIONS,
    "mention_lists": MENTIONS,
    "hashtags": HASHTAGS,
    "hashtag_lists": HASHTAGS,
}

LEXICON = _schema("word string, polarity double, subjectivity double, intensity double")

HASHTAG_CLASSES = _schema(
    "row int, phrase string, count long, survivor int, domestic_violence int, politics int, health int"
)
