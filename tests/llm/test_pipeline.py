"""The stages against plain Python on a small table."""

import hashlib
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import connect, differences
from postlens.llm import pii, quality, simhash
from postlens.llm.queries import QUERIES, SQL
from tests.llm.samples import SF_DIR, edges, empty, of
from tests.llm.test_simhash import plain_components, plain_fingerprint


def texts():
    """Different documents, copies, near copies, one without enough words and one with a phone number."""
    words = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(60)]
    words = ["".join(c for c in w if c.isalpha())[:7] or "word" for w in words]
    base = [" ".join(random.Random(i).sample(words, 45)) for i in range(12)]
    return [*base, base[0], base[1], base[0], base[2] + " more", "too short", base[4] + " call +1 (017) 555-7713 now", None]


def test_stages_by_brute_force(spark):
    docs = of(spark, texts()).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    rows = dict(enumerate(texts()))
    kept = {i: t for i, t in rows.items() if t and len(t.split()) >= 10}
    found = corpus_pipeline.quality_rules(spark, docs, "")
    assert {r["doc_id"] for r in found.collect()} == set(kept)
    last = {t: i for i, t in kept.items()}
    found = corpus_pipeline.exact_copies(spark, found, "")
    assert {r["doc_id"] for r in found.collect()} == set(last.values())
    groups = plain_components({i: plain_fingerprint(t) for t, i in last.items()})
    found = corpus_pipeline.near_copies(spark, found, "")
    single = {i for i, g in groups.items() if i == g}
    assert {r["doc_id"] for r in found.collect()} == single
    assert found.columns == docs.columns
    found = corpus_pipeline.personal_data(spark, found, "")
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.columns == docs.columns and set(got) == single
    phone = len(rows) - 2
    if phone in got:
        assert "[PHONE]" in got[phone]["text"] and "555" not in got[phone]["text"]
        assert got[phone]["n_chars"] == len(got[phone]["text"])
    packed = corpus_pipeline.pack(spark, found, "").collect()
    assert {r["doc_id"] for r in packed} == single


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (edges(spark), empty(spark)):
        for _, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, "")
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_copies", "near_copies", "personal_data", "packing"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, name):
    assert differences(spark, connect(SF_DIR), QUERIES[name], SQL[name], SF_DIR) == ""


def test_run(spark):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 100 < found.select("doc_id").distinct().count() < 200
    assert quality.STRICT.mask and pii.KINDS and simhash.SEED == 42
