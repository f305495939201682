"""Exact duplicates by content-defined chunks.

A text is cut where a rolling sum over its last 32 bytes hits a pattern, so
equal passages give equal chunks wherever they stand. A chunk's identifier is a
128-bit hash that is *verified*: every distinct chunk of the corpus is brought
together once by identifier and compared byte by byte; if two different chunks
ever share an identifier, identifiers with another seed are tried. From then on
only the ordered identifier lists are compared, never the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from postlens.llm.common import map_texts, per_task, raw, texts
from postlens.runtime import number_rows, stage

WINDOW, SHORTEST, LONGEST, MEAN_BITS = 32, 256, 8192, 10


def _gear() -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=2016) for b in range(256)], dtype=np.uint32)


def cuts(texts_: list[bytes], gear: np.ndarray) -> list[list[int]]:
    """For each text the places where its chunks end. An empty text has no chunk."""
    lengths = np.fromiter(map(len, texts_), np.int64, len(texts_))
    ends = np.cumsum(lengths)
    rolling = gear[np.frombuffer(b"".join(texts_), np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # after this each place holds the shifted sum of the 32 bytes up to it
        rolling[shift:] += rolling[:-shift] << np.uint32(shift)
    hits = np.flatnonzero(rolling >> np.uint32(32 - MEAN_BITS) == 0) + 1
    first = np.searchsorted(hits, ends - lengths)
    last = np.searchsorted(hits, ends)
    found = []
    for length, end, lo, hi in zip(lengths.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
        own, start = [], 0
        for hit in (hits[lo:hi] - (end - length)).tolist() + [length]:
            while hit - start > LONGEST:
                start += LONGEST
                own.append(start)
            if hit - start >= SHORTEST or hit == length > start:
                start = hit
                own.append(hit)
        found.append(own)
    return found


def _identifier(chunk: bytes, seed: int, bits: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed=seed)[: bits // 8]


def recipes(docs: DataFrame, seed: int = 0, bits: int = 128) -> DataFrame:
    """``doc_id, text_sha256, recipe``: the identifiers of the text's chunks in their order, end to end."""

    @per_task
    def start():
        gear = _gear()

        def work(batch):
            found = raw(batch)
            lists = [b"".join([_identifier(t[s:e], seed, bits) for s, e in zip([0, *c], c)]) for t, c in zip(found, cuts(found, gear), strict=True)]
            return {"doc_id": batch.column("doc_id"), "text_sha256": [hashlib.sha256(t).hexdigest() for t in found], "recipe": pa.array(lists, pa.binary())}

        return work

    return map_texts(docs, start, "doc_id long, text_sha256 string, recipe binary")


def chunk_store(docs: DataFrame, seed: int = 0, bits: int = 128) -> DataFrame:
    """``identifier, chunk``: the distinct chunks, each moved once per run of rows that holds it."""

    @per_task
    def start():
        gear = _gear()

        def work(batch):
            found = raw(batch)
            own = list({t[s:e] for t, c in zip(found, cuts(found, gear), strict=True) for s, e in zip([0, *c], c)})
            return {"identifier": pa.array([_identifier(x, seed, bits) for x in own], pa.binary()), "chunk": pa.array(own, pa.binary())} if own else None

        return work

    found = map_texts(docs, start, "identifier binary, chunk binary")
    return found.repartition("identifier").groupBy("identifier", "chunk").agg(F.count("*").alias("places"))


def _verified(docs: DataFrame, seed: int, bits: int) -> bool:
    return chunk_store(docs, seed, bits).groupBy("identifier").count().where("count > 1").limit(1).count() == 0


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, chunks`` for every row.

    Texts are equal when identical; null counts as empty, and empty texts equal
    each other. Of equal texts the row with the largest doc_id stays; a null id
    is smaller than any other, and of rows that repeat an id with the same text
    exactly one stays. Texts of any length are read whole. An empty table gives
    an empty result. ``bits`` is the width of the first identifiers tried.
    """
    docs = texts(docs, doc_id, text)
    seed = 0
    while not _verified(docs, seed, bits):
        seed, bits = seed + 1, min(128, bits * 2)
    rows = number_rows(recipes(docs, seed, bits), "row", "recipes")
    groups = stage(
        rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("keeper"), F.count("*").alias("group_size")),
        "recipe-groups",
    )
    return rows.join(groups, "recipe").select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keeper.row")).alias("kept"),
        "text_sha256",
        (F.octet_length("recipe") / (bits // 8)).cast("int").alias("chunks"),
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts."""
    keep = stage(
        exact_duplicates(docs, doc_id, text).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("same")).where("kept"),
        "keepers",
    )
    keep = keep.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("same").alias("__same"))
    sha = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
    kept = docs.join(keep, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (sha == F.col("__sha")))
    if keep.where("__same > 1").limit(1).count() == 0:
        return kept.drop("__id", "__sha", "__same")
    once, more = kept.where("__same = 1"), kept.where("__same > 1").dropDuplicates(["__id", "__sha"])
    return once.unionByName(more).drop("__id", "__sha", "__same")


OP4_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
