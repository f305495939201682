"""Language by prediction by partial matching: which language's model gives a text the shortest code.

A text is its bytes with A-Z in lower case and each run of ASCII signs that are no letters as
one blank: marks, digits and markup tell more about where a text comes from than about its
language. Each language has a tree of byte contexts of up to ``ORDER`` bytes, grown from a
bounded sample of its texts and then frozen. A byte is coded in its longest
context that the tree holds: with the share (n - d) / T if it was seen there, n times
of T; else an escape of d D / T is paid, D being the number of different bytes seen, and
the context one byte shorter is asked, where the bytes ruled out no longer count. Below
the empty context all bytes left are equally likely. So every byte has an exact code
length under every tree, and all of them add up to 1.

As statistics are frozen, a byte's code length depends on its window alone, the byte and
the ``ORDER`` bytes before it. Windows that some sample holds have their code lengths in
all trees worked out once, as a table; any other window is looked up in the trees, level
by level, once for each batch that holds it. Texts are scored whole, in one pass, as
sums over windows; trees and table are bounded by the sample.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.common import map_texts, per_task, raw

ORDER, ESCAPE = 4, 0.5
# Bytes of text to learn a language from, and for all languages together.
SAMPLE_BYTES, ALL_BYTES = 256 << 10, 8 << 20
UNKNOWN = "und"
_BEFORE = b"\n" * ORDER
_FOLD = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256)).lower()
_LETTER = re.compile(r"[^\W\d_]")


def folded(text: bytes) -> bytes:
    return b" ".join(text.translate(_FOLD).split())


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts, folded, one after the other, as numbers, and how many each text has."""
    texts = [folded(t) for t in texts]
    data = np.frombuffer(b"".join(_BEFORE + t for t in texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    keys = np.zeros(max(len(data) - ORDER, 0), np.int64)
    for i in range(ORDER + 1):
        keys = (keys << 8) | data[i : i + len(keys)]
    real = np.ones(len(keys), bool)
    ends = np.cumsum(lengths + ORDER)[:-1]
    for step in range(ORDER):  # the next text's first context is not coded
        at = ends - ORDER + step
        real[at[(at >= 0) & (at < len(keys))]] = False
    return keys[real], lengths


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stand in sorted ``keys``, and whether they do."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Tree:
    """A frozen context tree as sorted arrays, a level for each context length.

    Level k holds windows of k + 1 bytes with their counts and, for each context,
    its count, its different bytes, and how often the context one byte shorter was
    followed by one of these.
    """

    def __init__(self, levels: list[tuple]):
        self.levels = levels

    @classmethod
    def grown(cls, keys: np.ndarray) -> Tree:
        """The tree of all windows of ``keys``."""
        own, counts = np.unique(keys, return_counts=True)
        levels = [cls._level(own, counts)]
        for k in range(ORDER - 1, -1, -1):
            own = own & ((1 << 8 * (k + 1)) - 1)
            own, back = np.unique(own, return_inverse=True)
            counts = np.bincount(back, weights=counts).astype(np.int64) if len(own) else np.empty(0, np.int64)
            levels.insert(0, cls._level(own, counts))
        for k in range(1, ORDER + 1):
            windows_, _, contexts, _, _ = levels[k]
            shorter, n = levels[k - 1][:2]
            at, _ = _places(shorter, windows_ & ((1 << 8 * k) - 1))
            below = np.bincount(_places(contexts, windows_ >> 8)[0], weights=n[at], minlength=len(contexts)) if len(contexts) else np.empty(0)
            levels[k] = (*levels[k], below)
        return cls(levels)

    @staticmethod
    def _level(windows_: np.ndarray, counts: np.ndarray) -> tuple:
        contexts, back, kinds = np.unique(windows_ >> 8, return_inverse=True, return_counts=True)
        return windows_, counts, contexts, np.bincount(back, weights=counts, minlength=len(contexts)), kinds

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The code length of each window of distinct ``keys``."""
        return self._code(keys, ORDER)[0]

    def _code(self, keys: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Of windows of k + 1 bytes: bits, the byte's and its context's counts, the context's kinds, bits after an escape from a longer context that rules out none yet."""
        windows_, counts, contexts, totals, kinds = self.levels[k][:5]
        at, seen = _places(windows_, keys)
        n = np.where(seen, counts[at], 0) if len(windows_) else np.zeros(len(keys))
        at, known = _places(contexts, keys >> 8)
        t = np.where(known, totals[at], 0) if len(contexts) else np.zeros(len(keys))
        d = np.where(known, kinds[at], 0) if len(contexts) else np.zeros(len(keys))
        if not k:
            below = np.log2(np.maximum(256.0 - d, 1))
        else:
            shorter, back = np.unique(keys & ((1 << 8 * k) - 1), return_inverse=True)
            up_bits, up_n, up_t, up_d, up_below = (x[back] for x in self._code(shorter, k - 1))
            left = up_t - (np.where(known, self.levels[k][5][at], 0) if len(contexts) else 0)
            new = up_d - d  # bytes that the shorter context adds
            with np.errstate(divide="ignore", invalid="ignore"):
                coded = np.where(up_n > 0, -np.log2((up_n - ESCAPE) / left), up_below - np.log2(ESCAPE * new / left))
            below = np.where(t > 0, np.where(new > 0, coded, up_below), up_bits)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.where(n > 0, -np.log2((n - ESCAPE) / t), below - np.log2(ESCAPE * d / t))
        return np.where(t > 0, found, below), n, t, d, below


class Trees:
    """The trees of all languages, and the code lengths of the samples' windows in each."""

    def __init__(self, names: list[str], levels: list[list[tuple]], known: np.ndarray, table: np.ndarray):
        self.languages, self.trees, self.known, self.table = names, [Tree(x) for x in levels], known, table

    @classmethod
    def learnt(cls, samples: dict[str, list[bytes]]) -> Trees:
        names = sorted(samples)
        keys = [windows(samples[lang])[0] for lang in names]
        known = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        trees = cls(names, [Tree.grown(k).levels for k in keys], known, np.empty((0, 0)))
        trees.table = trees.bits(known)
        return trees

    def arrays(self) -> tuple:
        """What ``Trees`` is made of, as plain arrays."""
        return self.languages, [t.levels for t in self.trees], self.known, self.table

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code lengths of distinct windows, looked up in the trees."""
        return np.stack([t.bits(keys) for t in self.trees], axis=1) if self.trees else np.empty((len(keys), 0))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) under each language (columns)."""
        keys, lengths = windows(texts)
        codes, distinct = pd.factorize(keys)
        at, found = _places(self.known, distinct)
        bits = np.empty((len(distinct), len(self.languages)))
        bits[found] = self.table[at[found]]
        bits[~found] = self.bits(distinct[~found])
        total = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(lengths)
        if len(some):
            starts = (np.cumsum(lengths) - lengths)[some]
            for column in range(len(self.languages)):
                total[some, column] = np.add.reduceat(bits[codes, column], starts)
        return total


def _samples(labelled: DataFrame, most: int, all_bytes: int) -> dict[str, list[bytes]]:
    """Whole texts of each language, by hash, of about ``most`` bytes a language and never more than twice that, but one text at least."""
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    labelled = labelled.withColumn("unit", unit)
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"), F.min("unit").alias("least"))
    sizes = {r["lang"]: r for r in sizes.orderBy(F.desc("size"), "lang").limit(max(all_bytes // 4096, 1)).collect()}
    if not sizes:
        return {}
    each = max(4096, min(most, all_bytes // len(sizes)))
    share = F.create_map(*[x for lang, r in sizes.items() for x in (F.lit(lang), F.lit(max(each / max(r["size"], 1), r["least"])))])
    chosen = labelled.where(F.col("unit") <= F.try_element_at(share, F.col("lang")))
    samples: dict[str, list[bytes]] = {lang: [] for lang in sizes}
    room = dict.fromkeys(sizes, 2 * each)
    # about ``each`` bytes a language come back; copies of a text count once
    for row in chosen.select("lang", "text").distinct().orderBy("lang", F.xxhash64("text"), "text").toLocalIterator():
        text = row["text"].encode()
        if len(text) <= room[row["lang"]] or not samples[row["lang"]]:
            samples[row["lang"]].append(text)
            room[row["lang"]] -= len(text)
    return samples


def languages(docs: DataFrame, learn: Column, sample_bytes: int = SAMPLE_BYTES, all_bytes: int = ALL_BYTES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits`` for every row of ``docs``.

    The trees are learnt from rows for which ``learn`` holds and whose ``lang`` is not
    null. ``lang_pred`` is the language with the shortest code (ties: the smallest name),
    ``bits`` that code's length, and ``score`` its share if all languages are equally
    likely beforehand.
    Texts that are null or hold no letter, and all texts if no language is known, are
    ``und`` with score 0 and null bits. ``learn`` null counts as false. Repeated rows get
    a row each, texts are scored whole, an empty table gives an empty result. With more
    languages than ``all_bytes`` has shares of 4096 bytes, those with the least text are not learnt.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{lang}`").alias("lang"), F.coalesce(learn, F.lit(False)).alias("learn"))
    samples = _samples(own.where("learn and lang is not null and text <> ''").select("lang", "text"), sample_bytes, all_bytes)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Trees.learnt(samples).arrays())  # bounded by ``all_bytes``

    @per_task
    def scorer():
        trees = Trees(*model.value)
        names = np.array([*trees.languages, UNKNOWN], object)

        def work(batch: pa.RecordBatch) -> dict:
            texts = raw(batch)
            letters = np.array([_LETTER.search(t) is not None for t in batch.column("text").to_pylist()], bool)
            bits = trees.code_lengths(texts)
            if not len(trees.languages):
                best, score, least = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                letters[:] = False
            else:
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            best = np.where(letters, best, len(trees.languages))
            return {
                "doc_id": batch.column("doc_id"),
                "held_out": pa.compute.invert(batch.column("learn")),
                "lang_pred": pa.array(names[best].tolist(), pa.string()),
                "score": pa.array(np.where(letters, score, 0.0)),
                "bits": pa.array(least, mask=~letters),
            }

        return work

    return map_texts(own.select("doc_id", "text", "learn"), scorer, "doc_id long, held_out boolean, lang_pred string, score double, bits double", limit=1 << 20)
