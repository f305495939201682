import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import ppm as P
from tests.llm.samples import edge_texts, edges, empty, of

def learn():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0


def learns(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def plain(rows):
    """Scores by a trie and a counter in memory."""
    trie, words = P.Trie(), Counter()
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    for (i, t), own in zip(rows, tokens, strict=True):
        if learns(i):
            words.update(own)
            data = P.END * P.ORDER + P.folded((t or "").encode()) + P.END
            for at in range(P.ORDER, len(data)):
                trie.add(data[at - P.ORDER : at], data[at])
    total, known = sum(words.values()), len(words)
    return [
        (not learns(i), len(own), sum(words[w] > 0 for w in own), total, sum(math.log10((words[w] + 0.1) / (total + 0.1 * (known + 1))) for w in own), trie.code((t or "").encode(), False))
        for (i, t), own in zip(rows, tokens, strict=True)
    ]


def same(found, rows):
    got = [(r["doc_id"], tuple(r)[1:]) for r in found]
    assert len(got) == len(rows)
    left = list(got)
    for (i, _), want in zip(rows, plain(rows), strict=True):
        match = [g for g in left if g[0] == i and g[1][:4] == want[:4] and g[1][4] == pytest.approx(want[4], rel=1e-9) and g[1][5] == pytest.approx(want[5], rel=1e-5)]
        assert match, (i, want)
        left.remove(match[0])


def test_scores_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(P, "RUN_BYTES", 700)
    texts = [f"Some {w} text, with the {w}{i % 3} and  more\nof it. É {i % 7}" * (i % 4) for i, w in enumerate("red blue green fast slow old new round".split() * 12)]
    rows = list(enumerate([*texts, "entirely différent", None]))
    same(P.scores(of(spark, [t for _, t in rows]), learn()).collect(), rows)


def test_probabilities_of_all_bytes_sum_to_one():
    trie = P.Trie()
    trie.code(b"abracadabra abracadabra, she said", True)
    for before in (b"abrac", b"zzzzz", b"d abr", b"xxxra"):
        assert sum(10 ** trie.value(before, s) for s in range(256)) == pytest.approx(1)


def test_odd_rows(spark):
    rows = [(i, t) for i, t in edge_texts() if t is None or len(t) < 5000]
    docs = edges(spark).where("text is null or length(text) < 5000")
    same(P.scores(docs, learn()).collect(), rows)
    assert P.scores(edges(spark), learn()).count() == len(edge_texts())


def test_empty_table_and_no_training_rows(spark):
    assert P.scores(empty(spark), learn()).count() == 0
    found = P.scores(of(spark, ["ab", None]), F.lit(False)).orderBy("doc_id").collect()
    assert [r["train_tokens"] for r in found] == [0, 0]
    assert [r["score"] for r in found] == pytest.approx([-3 * math.log10(256), -math.log10(256)], rel=1e-5)
    assert [r["base_score"] for r in found] == pytest.approx([0, 0], abs=1e-9)


def test_adaptive(spark):
    found = P.adaptive_scores(of(spark, ["abab abab abab abab", None])).orderBy("doc_id").collect()
    assert found[0]["score"] == pytest.approx(P.Trie().code(b"abab abab abab abab", True))
    assert found[0]["score"] > -20 * math.log10(256) * 0.6
    assert found[1]["score"] == pytest.approx(-math.log10(256))


def test_a_task_holds_a_few_rows_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 300)
    monkeypatch.setattr(P, "DEALT", 50)
    held = {}

    def watched(df, label, rows_per_file=0, real=P.stage):
        held[label] = real(df, label, rows_per_file)
        return held[label]

    monkeypatch.setattr(P, "stage", watched)
    rows = [(i, f"word{i} and word{i % 5} of some text ") for i in range(150)]
    same(P.scores(of(spark, [t for _, t in rows]).coalesce(1), learn()).collect(), rows)
    blocks, requests = held["blocks"], held["requests"]
    assert blocks.count() >= 15
    # whatever the number of blocks, Spark reads few of them at once, and few of their requests
    files = blocks.groupBy(F.input_file_name()).agg(F.sum(F.aggregate("sizes", F.lit(0), lambda n, t: n + t)).alias("n"))
    assert files.agg(F.max("n")).first()[0] <= P.BLOCKS_PER_FILE * (300 + 40)
    assert requests.groupBy(F.input_file_name()).agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] <= 2 * P.BLOCKS_PER_FILE + 1
    assert requests.select("part").distinct().count() <= max(P.LEAST_PARTS, -(-blocks.count() // P.BLOCKS_PER_PART))


def test_sorted_windows_are_packed_without_loss():
    rng = np.random.default_rng(1)
    for keys in (np.empty(0, np.int64), np.unique(rng.integers(0, 1 << 48, 999))):
        assert P._keys_of(P._packed_keys(keys)).tolist() == keys.tolist()
        for kind in (np.int32, np.float32):
            own = keys.astype(kind)
            assert P._of_planes(P._planes(own), kind).tolist() == own.tolist()
