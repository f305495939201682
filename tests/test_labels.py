import datetime

import pytest
from pyspark.sql import functions as F

from postlens.operators import labels
from postlens.plans import model_runs
from postlens.schemas import HASHTAG_CLASSES
from tests.conftest import rows

CLASSES = [
    (1, "metoo", 10, 1, 0, 0, 0),
    (2, "stayed", 10, 1, 1, 0, 0),
    (3, "home", 5, 0, 1, 0, 0),
    (4, "vote", 5, 0, 0, 1, 0),
    (5, "clinic", 50, 0, 0, 0, 1),
    (6, "nothing", 99, 0, 0, 0, 0),
    (7, "vote", 4, 0, 0, 1, 0),
    (8, "both", 3, 0, 1, 1, 0),
    (9, "uncounted", None, 0, 1, 0, 0),
]


@pytest.fixture(scope="module")
def lookup(spark):
    return labels.class_lookup(spark.createDataFrame(CLASSES, HASHTAG_CLASSES))


@pytest.fixture(scope="module")
def posts(spark):
    tags = {
        1: "home", 2: "vote", 3: "clinic", 4: "metoo", 5: "stayed", 6: "stayed metoo", 7: "both",
        8: "home clinic", 9: "nothing", 10: "", 11: "home home vote", 12: "uncounted", 13: "stayed stayed",
    }
    return spark.createDataFrame([(i, t) for i, t in tags.items()], "id long, hashtags string")


def test_unflagged_phrases_are_left_out(lookup):
    assert rows(lookup.filter("phrase = 'nothing'"), "phrase") == []
    assert lookup.count() == 8


def test_weights(lookup, posts):
    got = {r[0]: r[1:] for r in rows(labels.add_hashtag_weights(posts, lookup), "id", "survivor", *labels.CLASSES)}
    assert got[2] == (0, 0, 4, 0)  # the last row of a repeated phrase wins
    assert got[11] == (0, 10, 4, 0)  # tags count as often as they occur
    assert got[6] == (2, 10, 0, 0)
    assert got[12] == (0, 0, 0, 0)


def test_joined_weights_agree(lookup, posts):
    columns = ["id", "survivor", *labels.CLASSES]
    assert rows(labels.add_hashtag_weights(posts, lookup), *columns) == rows(
        labels.add_hashtag_weights(posts, lookup, max_rows=0), *columns
    )


def test_labels(lookup, posts):
    assert rows(labels.label_posts(posts, lookup), "id", "category") == [
        (1, "Domestic Violence"),
        (2, "Politics"),
        (5, "Victim/Survivor"),
        (6, "Domestic Violence"),  # two survivor tags do not count
        (7, "Domestic Violence"),  # a tie goes to the first class
        (8, "Health"),
        (11, "Domestic Violence"),
        (13, "Domestic Violence"),
    ]


def test_relaxed_rules(lookup, posts):
    got = dict(rows(labels.label_posts(posts, lookup, several_survivor_tags=True, count_last_class=True), "id", "category"))
    assert got[3] == "Health" and got[6] == got[13] == "Victim/Survivor" and 4 not in got


def test_model_rows(spark):
    month, held = datetime.date(2021, 5, 1), datetime.date(2022, 1, 1)
    posts = spark.createDataFrame(
        [
            (1, "a", month, "x", 0.575, 0.125, None, None),
            (2, "a", month, "", 0.0, 0.0, "n", "t"),
            (3, "a", month, None, 0.0, 0.0, "n", "t"),
            (4, "b", held, "y", -0.375, 0.0, "n", "t"),
            (5, "c", None, "z", 0.0, 0.0, "n", "t"),
        ],
        "id long, username string, month date, content string, sentiment double, subjectivity double, "
        "mentioned_usernames string, hashtags string",
    )
    train = labels.model_rows(posts)
    assert rows(train, "id", "contents", "sentiment", "subjectivity", "mentions", "hashtags") == [
        (1, "x", 0.57, 0.12, "", ""),
        (5, "z", 0.0, 0.0, "n", "t"),
    ]
    assert rows(labels.model_rows(posts, training=False), "id", "username", "sentiment") == [(4, "b", -0.38)]


def test_merged_classes():
    assert [model_runs._merged(c) for c in ("Health", labels.SURVIVOR)] == [labels.OTHER, labels.SURVIVOR]


def test_blank_last_row_removes_a_phrase(spark):
    table = spark.createDataFrame([(1, "vote", 10, 0, 0, 1, 0), (2, "vote", None, 0, 0, 1, 0)], HASHTAG_CLASSES)
    weights = labels.hashtag_weights(labels.class_lookup(table))
    assert rows(weights, "phrase", "politics", "survivor") == [("vote", 0, 0)]
