"""Token ids in a binary file with access to any token.

Directly addressable codes: an id is cut into chunks of 8 bits, lowest first. Level
0 holds the first chunk of all tokens, level k the chunk k of those tokens that
have one. For each level but the last a bitmap says which of its entries go on at
the next level, and a rank directory holds the ones before each 512 bits of it.
Token i is then read as byte i of level 0; if its bit is set, the rank of the bit
is its place at level 1, and so on. Nothing else is decoded.

A file (a *shard*) holds a run of documents in ascending order. Shards are written
by Spark, one row each, so that they are committed by whole tasks and can lie in
any store that Spark writes to. Layout, all little-endian:

    magic "DAC1" | u32 documents | u64 tokens | u32 levels
    documents x i64 ids | documents x u8 null flags | (documents + 1) x u64 first token
    per level: u64 entries | entries x u8 | and, but for the last level:
        u64 words | words x u64 bitmap | u64 blocks | blocks x u32 ones before the block
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.llm.common import raw, slices, texts
from postlens.llm.tokens import word_ids
from postlens.runtime import scratch_path

MAGIC, BLOCK_WORDS = b"DAC1", 8
# A shard is closed once it holds so many tokens.
SHARD_TOKENS = 4 << 20
SHARD_SCHEMA = "shard long, documents long, tokens long, before_in_task long, payload binary"


def build(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a shard."""
    first = np.concatenate(([0], np.cumsum(np.array(counts, np.uint64), dtype=np.uint64))).astype("<u8")
    parts = [
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], "u1").tobytes(),
        first.tobytes(),
    ]
    levels, rest = 0, ids.astype("<u4")
    while True:
        levels += 1
        parts += [struct.pack("<Q", len(rest)), (rest & 255).astype("u1").tobytes()]
        more = rest > 255
        if not more.any():
            break
        words = -(-len(rest) // 64)
        bitmap = np.zeros(words * 64, bool)
        bitmap[: len(rest)] = more
        bitmap = np.packbits(bitmap, bitorder="little").view("<u8")
        ones = np.bitwise_count(bitmap).astype(np.int64)
        ranks = np.concatenate(([0], np.cumsum(np.add.reduceat(ones, np.arange(0, words, BLOCK_WORDS)))[:-1])).astype("<u4")
        parts += [struct.pack("<Q", words), bitmap.tobytes(), struct.pack("<Q", len(ranks)), ranks.tobytes()]
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<IQI", len(doc_ids), len(ids), levels) + b"".join(parts)


class Shard:
    """A shard's bytes, read in place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token file")
        n, self.tokens, levels = struct.unpack_from("<IQI", payload, 4)
        self._data, self._at = payload, 20
        self.doc_ids, self.nulls, self.first = self._take("<i8", n), self._take("u1", n), self._take("<u8", n + 1)
        self.levels = []
        for level in range(levels):
            chunks = self._take("u1", self._count())
            last = level == levels - 1
            self.levels.append((chunks, None if last else self._take("<u8", self._count()), None if last else self._take("<u4", self._count())))

    def _count(self) -> int:
        self._at += 8
        return struct.unpack_from("<Q", self._data, self._at - 8)[0]

    def _take(self, kind: str, n: int) -> np.ndarray:
        found = np.frombuffer(self._data, kind, n, self._at)
        self._at += found.nbytes
        return found

    def tokens_at(self, places) -> np.ndarray:
        """The tokens at any places, in any order."""
        places = np.asarray(places, np.int64)
        found, shift, open_ = np.zeros(len(places), np.uint32), 0, np.arange(len(places))
        for chunks, bitmap, ranks in self.levels:
            found[open_] |= chunks[places].astype(np.uint32) << np.uint32(shift)
            if bitmap is None:
                break
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            more = (bitmap[word] >> bit & np.uint64(1)).astype(bool)
            places, word, bit, open_ = places[more], word[more], bit[more], open_[more]
            block = word // BLOCK_WORDS
            rank = ranks[block].astype(np.int64) + np.bitwise_count(bitmap[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            for step in range(BLOCK_WORDS - 1):  # the whole words between the block's start and this word
                at = block * BLOCK_WORDS + step
                rank += np.where(at < word, np.bitwise_count(bitmap[np.minimum(at, len(bitmap) - 1)]), 0)
            places, shift = rank, shift + 8
        return found

    def run(self, begin: int, stop: int) -> np.ndarray:
        """The tokens of a run: it is a run at every level, so one rank a level is enough."""
        found, shift, open_ = np.zeros(stop - begin, np.uint32), 0, np.arange(stop - begin)
        for chunks, bitmap, ranks in self.levels:
            found[open_] |= chunks[begin:stop].astype(np.uint32) << np.uint32(shift)
            if bitmap is None or begin == stop:
                break
            first = begin >> 6
            more = np.unpackbits(bitmap[first : (stop + 63) >> 6].view("u1"), bitorder="little")[begin - 64 * first :][: stop - begin].astype(bool)
            block = first // BLOCK_WORDS
            ahead = np.bitwise_count(bitmap[block * BLOCK_WORDS : first]).sum(dtype=np.int64)
            ahead += int(bitmap[first] & np.uint64((1 << (begin & 63)) - 1)).bit_count()
            begin = int(ranks[block]) + int(ahead)
            stop, open_, shift = begin + int(more.sum()), open_[more], shift + 8
        return found

    def __getitem__(self, place: int) -> int:
        return int(self.tokens_at([place])[0])

    def document(self, number: int) -> np.ndarray:
        return self.run(int(self.first[number]), int(self.first[number + 1]))


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, append ``end_id``, write shards in ascending doc_id order under ``path``.

    Null texts are empty; null ids come first; repeated rows stay, side by side.
    A shard is a run of whole documents of ``SHARD_TOKENS`` tokens or one
    document more; an empty table gives no shard. Other columns are not read.
    """
    own = texts(docs, doc_id, text)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, counts, parts, before = word_ids(tokenizer), [], [], [], 0

        def out() -> pa.RecordBatch:
            payload = build(ids, counts, np.frombuffer(b"".join(parts), "<u4"))
            row = {"documents": [len(ids)], "tokens": [sum(counts)], "before_in_task": [before], "payload": pa.array([payload], pa.binary())}
            for x in (ids, counts, parts):
                x.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in slices(batches):
            for one, content in zip(batch.column("doc_id").to_pylist(), raw(batch), strict=True):
                ids.append(one)
                parts.append(words.text(content) + end)
                counts.append(len(parts[-1]) // 4)
            if (own_tokens := sum(counts)) >= SHARD_TOKENS:
                yield out()
                before += own_tokens
        if ids:
            yield out()

    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(encode, "documents long, tokens long, before_in_task long, payload binary")
    shards.withColumn("shard", F.monotonically_increasing_id()).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``first_token``, the tokens of all shards before.

    A shard knows the tokens that its own task wrote before it; one sum for each of
    the writer's tasks (the upper bits of the shard's number) is added to that.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).withColumn("task", F.shiftright("shard", 33))
    tasks = shards.groupBy("task").agg(F.sum("tokens").alias("sum")).toPandas().sort_values("task")
    before = pd.DataFrame({"task": tasks["task"], "before": tasks["sum"].cumsum() - tasks["sum"]}).astype("int64")
    before = spark.createDataFrame(before, "task long, before long")
    return shards.join(F.broadcast(before), "task").withColumn("first_token", F.col("before_in_task") + F.col("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: the documents of a token file with their ids (uint32 bytes)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column("first_token").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                shard = Shard(payload)
                at, step = 0, 256
                while at < len(shard.doc_ids):
                    numbers = range(at, min(at + step, len(shard.doc_ids)))
                    begin, stop = int(shard.first[numbers[0]]), int(shard.first[numbers[-1] + 1])
                    data = shard.run(begin, stop).astype("<u4").tobytes()
                    bounds = (shard.first[numbers[0] : numbers[-1] + 2].astype(np.int64) - begin).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if shard.nulls[i] else int(shard.doc_ids[i]) for i in numbers], pa.int64()),
                            pa.array([first + begin + s for s in bounds[:-1]], pa.int64()),
                            pa.array([e - s for s, e in zip(bounds, bounds[1:])], pa.int64()),
                            pa.array([data[4 * s : 4 * e] for s, e in zip(bounds, bounds[1:])], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    at += step

    return read_shards(spark, path).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a token file of ``docs`` and read it back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = scratch_path(docs.sparkSession, "token-file")
    write_token_file(docs, path, tokenizer, end_id, doc_id, text)
    return read_documents(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


