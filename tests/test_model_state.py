"""Vocabularies kept by month."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from postlens.operators import features
from postlens.plans import model_state
from postlens.sources import commits
from tests.conftest import rows
from tests.test_knn import COLUMNS, make

MONTHS = [datetime.date(2021, m, 1) for m in (1, 2, 3)]


def month_rows(spark, seed, n=30):
    rng = random.Random(seed)
    return spark.createDataFrame([make(rng, seed * 100 + i, alphabet="abcdefghij"[seed:]) for i in range(n)] + [(0, seed * 100 + 99, "", None, "", 0.0, 0.0)], COLUMNS)


def vocabulary(model):
    return rows(model.idf, "block", "token", "df", "idf")


def test_months_add_up_to_a_fit_of_their_posts(spark, tmp_path):
    folder = f"{tmp_path}/state"
    assert model_state.stored_months(spark, folder) == {}
    with pytest.raises(ValueError, match="no month"):
        model_state.model(spark, folder)
    parts = {m: month_rows(spark, i) for i, m in enumerate(MONTHS, 1)}
    for month, part in parts.items():
        assert model_state.add_month(part, month, folder)
        assert not model_state.add_month(part, month, folder)
    whole = parts[MONTHS[0]].unionByName(parts[MONTHS[1]]).unionByName(parts[MONTHS[2]])
    assert vocabulary(model_state.model(spark, folder)) == vocabulary(features.fit(whole))
    assert rows(model_state.model(spark, folder).sizes, "run", "n") == [(0, 93)]
    early = parts[MONTHS[0]].unionByName(parts[MONTHS[1]])
    assert vocabulary(model_state.model(spark, folder, until=MONTHS[2])) == vocabulary(features.fit(early))
    # a withdrawn month leaves no trace, and may come again
    assert model_state.withdraw_month(spark, MONTHS[2], folder) and not model_state.withdraw_month(spark, MONTHS[2], folder)
    assert vocabulary(model_state.model(spark, folder)) == vocabulary(features.fit(early))
    changed = month_rows(spark, 4, 12)
    assert model_state.add_month(changed, MONTHS[2], folder, "corrected")
    assert vocabulary(model_state.model(spark, folder)) == vocabulary(features.fit(early.unionByName(changed)))
    assert model_state.withdraw_month(spark, MONTHS[2], folder)
    assert set(model_state.stored_months(spark, folder)) == set(MONTHS[:2])
    weights = model_state.model(spark, folder).transform(early)
    assert rows(weights, "id", "block", "token", "weight") == rows(features.fit(early).transform(early), "id", "block", "token", "weight")


def test_a_month_reads_nothing_of_the_others(spark, tmp_path):
    folder = f"{tmp_path}/state"
    model_state.add_month(month_rows(spark, 1), MONTHS[0], folder)
    model_state.add_month(month_rows(spark, 2), MONTHS[1], folder)
    own = commits.manifests(spark, folder)
    assert [m["key"] for m in own] == ["add-2021-01-01", "add-2021-02-01"]
    stored = spark.read.parquet(f"{folder}/frequencies/commit=add-2021-02-01")
    assert rows(stored, "block", "token", "df") == rows(features.document_frequencies(month_rows(spark, 2).withColumn("x", F.lit(1)), []), "block", "token", "df")
