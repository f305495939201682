import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import language as L
from postlens.llm.queries import op11_language
from tests.conftest import rows
from tests.llm.samples import SF_DIR, edges, empty, of

TRAIN = [b"The cat sat on the mat and the dog sat on the log.", b"then the thin man thanked them", b"", "Der Bär wär hier".encode()]
EN = "the house on the hill was white and the garden was green with all the trees of the old farm"
DE = "das haus auf dem berg war weiss und der garten war gruen mit allen baeumen des alten hofes"


def plain_fold(text: bytes) -> bytes:
    return re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower()).strip(b" ")


class PlainTree:
    """The same model with dictionaries, one byte at a time."""

    def __init__(self, texts):
        self.nodes = {}
        for text in texts:
            data = b"\n" * L.ORDER + plain_fold(text)
            for at in range(L.ORDER, len(data)):
                for length in range(L.ORDER + 1):
                    node = self.nodes.setdefault(data[at - length : at], {})
                    node[data[at]] = node.get(data[at], 0) + 1

    def bits(self, before: bytes, symbol: int) -> float:
        total, excluded = 0.0, set()
        for length in range(L.ORDER, -1, -1):
            node = {s: n for s, n in self.nodes.get(before[L.ORDER - length :], {}).items() if s not in excluded}
            if not node:
                continue
            if symbol in node:
                return total - math.log2((node[symbol] - L.ESCAPE) / sum(node.values()))
            total -= math.log2(L.ESCAPE * len(node) / sum(node.values()))
            excluded |= set(node)
        return total + math.log2(256 - len(excluded))

    def code(self, text: bytes) -> float:
        data = b"\n" * L.ORDER + plain_fold(text)
        return sum(self.bits(data[at - L.ORDER : at], data[at]) for at in range(L.ORDER, len(data)))


def test_code_lengths_are_those_of_the_plain_model():
    texts = [b"The thin cat thanked the dog", b"", b"zebra \xc3\xa9\xff", "der Bär".encode(), b"the " * 50, TRAIN[0]]
    found = L.Trees.learnt({"x": TRAIN, "y": [b"abracadabra", b"a"]}).code_lengths(texts)
    one, two = PlainTree(TRAIN), PlainTree([b"abracadabra", b"a"])
    for text, (x, y) in zip(texts, found.tolist(), strict=True):
        assert x == pytest.approx(one.code(text)) and y == pytest.approx(two.code(text))


def test_all_bytes_together_have_probability_one():
    tree = L.Tree.grown(L.windows(TRAIN)[0])
    for before in (b"the ", b"zzzz", b"\n\n\n\n", b"t on", b"zthe"):
        keys = np.array([int.from_bytes(before + bytes([s]), "big") for s in range(256)])
        assert np.exp2(-tree.bits(keys)).sum() == pytest.approx(1)


def test_marks_between_words_say_nothing(spark):
    noisy = "".join(f"{w}{m} " for w, m in zip(EN.split(), ["***", "$$$", "%%%", "&&&"] * 9))  # noqa: B905
    own = [(1, EN, "en"), (2, DE, "de"), (3, DE.replace(" ", "*** "), "de"), (4, noisy, None)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string")
    assert rows(L.languages(docs, F.col("doc_id") < 4).where("doc_id = 4"), "lang_pred") == [("en",)]


def test_no_sample_at_all_leaves_every_byte_equal():
    assert L.Trees.learnt({"x": [b""]}).code_lengths([b"abc"]).tolist() == [[24.0]]


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = op11_language(spark, SF_DIR).join(docs.select("doc_id", "lang", "text"), "doc_id").where(F.col("held_out") & F.col("text").rlike("[a-z]"))
    right, all_ = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert all_ > 30 and right / all_ > 0.97


def test_edges(spark):
    found = L.languages(edges(spark).withColumn("lang", F.when(F.col("doc_id") == 7, "en").when(F.col("doc_id") == 11, "xx")), F.lit(True))
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == edges(spark).count()
    assert {i: got[i]["lang_pred"] for i in (1, 2, 3, 8)} == {1: "und", 2: "und", 3: "und", 8: "en"}
    assert got[1]["score"] == 0 and got[1]["bits"] is None and got[8]["score"] > 0.99
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert L.languages(empty(spark), F.lit(True)).count() == 0
    assert rows(L.languages(of(spark, ["abc"]).withColumn("lang", F.lit("en")), F.lit(None).cast("boolean")), "lang_pred", "held_out") == [("und", True)]


def test_sample_is_bounded_and_ties_go_to_the_smaller_name(spark):
    own = [(i, f"{EN} {i}" if i % 2 else f"{DE} {i}", "en" if i % 2 else "de") for i in range(400)] + [(1000, EN, "en")] * 300
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string")
    samples = L._samples(docs.select("lang", "text"), 8192, 1 << 20)
    assert {k for k in samples} == {"en", "de"} and all(2000 < sum(map(len, v)) <= 16384 for v in samples.values())
    assert all(len(set(v)) == len(v) for v in samples.values())
    found = L.languages(docs, F.col("doc_id") < 1001, sample_bytes=8192)
    assert found.where((F.col("doc_id") < 400) & (F.col("lang_pred") == F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))).count() == 400
    same = spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a")], "doc_id long, text string, lang string")
    assert rows(L.languages(same, F.lit(True)), "lang_pred", "score") == [("a", 0.5), ("a", 0.5)]
