"""Registered queries against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences
from checks.oracles import statements
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

# one query per part of the work; checks.compare runs all of them
SAMPLE = [
    "capture_monthly", "read_raw", "bi_export", "clean_text", "post_enrich", "sentiment_modified",
    "monthly_ngrams", "top_words_monthly", "label_posts", "tfidf_transform", "knn_classify",
    "method_testing", "topic_model", "mention_parse", "hashtag_parse", "join_mentions", "ingest_inbox",
    "knn_score_month",
]

needs_data = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables")


def test_every_query_has_its_statement():
    assert set(QUERIES) == set(statements())
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, name):
    found = differences(spark, connect(SF_DIR), entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert found == ""


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "ngram_type", "month", "phrase", "count"]
