"""Entity tables, sentiment and the enriched posts."""

import datetime

import pytest
from pyspark.sql import functions as F, types as T

from postlens import runtime
from postlens.functions import entities as functions, text
from postlens.operators import entities
from postlens.operators.dictionary import word_sums
from postlens.operators.sentiment import add_modified_sentiment, add_sentiment
from postlens.plans.enrich import clean_posts, process_raw
from postlens.schemas import FAMILIES, LEXICON, RAW_POSTS
from tests.conftest import rows

DAY = datetime.datetime(2021, 3, 31, 12, 30)


def post(key, content, users=None, tags=None):
    return (key, DAY, "me", "Me", content, 1, 2, 3, 4, users, tags)


USERS = (
    "[User(username='ann', id=1, displayname='Ann, the first', description=None), "
    "User(username='bob', id=2, displayname=\"Bob O'Hara\", description=None)]"
)

RAW = [
    post(1, "Good day &amp; http://x.y/z @ann #MeToo", USERS, "['MeToo', 'Été']"),
    post(2, None),
    post(3, "", "[]", "[]"),
    post(4, "bad never good good unknown"),
    post(5, "first copy good", USERS, "['one']"),
    post(5, "second copy bad", None, "['two']"),
    post(5, "third copy", "[User(username='carl', id=3, displayname='Carl', description=None)]", None),
]

LEXICON_ROWS = [("good", 0.7, 0.6, 1.0), ("bad", -0.7, 0.65, 1.0), ("day", 0.0, 0.0, 1.0), ("never", 0.0, 0.1, 1.0)]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, RAW_POSTS)


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON_ROWS, LEXICON)


@pytest.fixture(scope="module")
def families(raw, lexicon):
    return process_raw(raw, lexicon)


def test_schemas(families):
    for name, schema in FAMILIES.items():
        got = [(f.name, f.dataType) for f in families[name].schema]
        assert got == [(f.name, f.dataType) for f in schema], name


def test_sentiment(families):
    got = rows(families["posts"].filter("id < 5"), "id", "content", "sentiment", "polarity", "subjectivity")
    assert got == [
        (1, "good day", 0.35, "Positive", 0.3),
        (2, "", 0.0, "Positive", 0.0),
        (3, "", 0.0, "Positive", 0.0),
        (4, "bad never good good unknown", 0.175, "Positive", pytest.approx((0.65 + 0.1 + 1.2) / 4)),
    ]


def test_dates(families):
    got = families["posts"].select("date", "month").distinct().collect()
    assert [tuple(r) for r in got] == [(datetime.date(2021, 3, 31), datetime.date(2021, 3, 1))]


def test_mentions(families):
    assert rows(families["mentions"].filter("id < 5"), "id", "username", "display_name") == [
        (1, "ann bob", "Ann the first Bob OHara"),
        (3, "", ""),
    ]
    assert rows(families["mention_lists"].filter("id < 5"), "id", "username", "display_name") == [
        (1, "ann", "Ann, the first"),
        (1, "bob", "Bob O'Hara"),
        (3, None, None),
    ]


def test_hashtags(families):
    assert rows(families["hashtags"].filter("id < 5"), "id", "hashtags") == [(1, "metoo été"), (3, "")]
    assert rows(families["hashtag_lists"].filter("id < 5"), "id", "hashtags") == [(1, "#metoo"), (1, "#été")]


def test_repeated_ids_multiply(families):
    got = rows(families["posts"].filter("id = 5"), "content", "mentioned_usernames", "hashtags")
    expected = [
        (content, users, tags)
        for content in ("first copy good", "second copy bad", "third copy")
        for users in ("ann bob", "carl")
        for tags in ("one", "two")
    ]
    assert got == sorted(expected)


def test_own_rows_and_joins_agree(raw, lexicon):
    base = clean_posts(raw, lexicon)
    columns = FAMILIES["posts"].fieldNames()
    # a limit below any size sends all rows through the joins
    assert rows(entities.merge_entities(base), *columns) == rows(entities.merge_entities(base, limit=-1), *columns)
    single = base.filter("id <> 5")
    assert rows(entities.merge_entities(single), *columns) == rows(entities.merge_entities(single, limit=-1), *columns)


def test_staged_posts_agree(raw, lexicon, families):
    staged = process_raw(raw, lexicon, staged=True)
    for name, schema in FAMILIES.items():
        assert rows(staged[name], *schema.fieldNames()) == rows(families[name], *schema.fieldNames()), name


def test_scores_of_both_ways_agree(spark, lexicon):
    frame = spark.createDataFrame(
        [(1, "good good bad"), (1, "good"), (1, "good"), (2, ""), (3, "xx yy"), (4, "never bad day " * 50)],
        "id long, content string",
    )
    words = text.clean_words(F.col("content"))
    columns = ["id", "content", "sentiment", "polarity", "subjectivity"]
    assert rows(add_sentiment(frame, words, lexicon), *columns) == rows(
        add_sentiment(frame, words, lexicon, max_rows=0), *columns
    )


def test_empty_dictionary(spark, lexicon):
    frame = spark.createDataFrame([(1, ["a"])], "id long, t array<string>")
    empty = lexicon.filter("false").select("word", F.lit(1).cast("long").alias("w"))
    assert rows(word_sums(frame, F.col("t"), empty, "word", ["w"]), "id", "w") == [(1, 0)]


def test_modifiers_and_negations(spark):
    lexicon = spark.createDataFrame(
        [("good", 0.7, 0.6, 1.0), ("bad", -0.8, 0.5, 1.0), ("really", 0.2, 0.2, 1.3), ("barely", 0.1, 0.1, 0.5)], LEXICON
    )
    cases = {
        "good": (0.7, 0.6),
        "really good": (0.91, 0.78),
        "really bad": (-1.0, 0.65),  # not below -1
        "barely really good": (0.91, 0.78),  # the nearest modifier counts
        "really": (0.2, 0.2),  # nothing to modify
        "really x good": (0.45, 0.4),  # not next to each other
        "never good": (-0.35, 0.6),
        "never barely good": (-0.5, 1.0),  # 0.7 / 0.5, at most 1, turned and halved
        "never x good": (0.7, 0.6),
        "never": (0.0, 0.0),
        "good never bad": (0.55, 0.55),
        "": (0.0, 0.0),
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "id long, content string")
    scored = add_modified_sentiment(frame, F.split("content", " "), lexicon)
    got = {content: (s, u) for content, s, u in rows(scored, "content", "sentiment", "subjectivity")}
    for content, expected in cases.items():
        assert got[content] == pytest.approx(expected), content


def test_senses_are_averaged_and_gaps_are_neutral(spark):
    lexicon = spark.createDataFrame(
        [("fine", 0.4, 0.5, 1.0), ("fine", 0.2, 0.1, 1.0), ("odd", None, 0.3, None)], LEXICON
    )
    frame = spark.createDataFrame([(1, "fine"), (2, "odd fine")], "id long, content string")
    for add in (add_sentiment, add_modified_sentiment):
        got = rows(add(frame, F.split("content", " "), lexicon), "id", "sentiment", "subjectivity")
        assert [x for r in got for x in r] == pytest.approx([1, 0.3, 0.3, 2, 0.15, 0.3])


def test_names_stay_with_their_users(spark):
    users = (
        "[User(username='a', displayname=None, x=1), User(username='b', displayname='Bee, B', x=1), "
        "User(username='c', displayname=\"O'C\", x=1), User(username='d')]"
    )
    frame = spark.createDataFrame([(users,), ("[]",), (None,)], "u string")
    got = frame.select(functions.mention_usernames(F.col("u")), functions.mention_display_names(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c", "d"], [None, "Bee, B", "O'C", None]), ([], []), (None, None)]


def test_lists_with_escapes(spark):
    lists = [["ok", "a\xa0b"], ["it's", 'say "x"', "both ' \""], ["tab\t", "back\\slash", "\u200b", "\U000e0041", "é\U0001f600"], [], ["x" * 9000]]
    frame = spark.createDataFrame([(i, str(x)) for i, x in enumerate(lists)] + [(9, None), (10, "['torn"), (11, "word")], "i int, t string")
    got = {r[0]: (r[1], r[2]) for r in frame.select("i", functions.hashtag_array(F.col("t")), functions.readable_list(F.col("t"))).collect()}
    assert [got[i] for i in range(len(lists))] == [(x, True) for x in lists]
    assert got[9] == (None, True) and got[10] == got[11] == (None, False)


def test_frequent_words_are_spread(spark):
    left = spark.createDataFrame([(i, "often" if i % 3 else f"w{i}") for i in range(200)], "id long, word string")
    right = spark.createDataFrame([("often", 1)] + [(f"w{i}", i) for i in range(150)], "word string, n int")
    assert rows(runtime.join_spread(left, right, ["word"], -1), "id", "n") == rows(left.join(right, "word"), "id", "n")


def test_captures_are_merged_by_themselves(spark, lexicon):
    frame = spark.createDataFrame([(*r, c) for c in ("x", "y") for r in RAW if r[0] == 5 and r[1]], T.StructType([*RAW_POSTS.fields, T.StructField("capture", T.StringType())]))
    one = process_raw(frame.filter("capture = 'x'"), lexicon)["posts"].count()
    assert process_raw(frame, lexicon)["posts"].count() == 2 * one
