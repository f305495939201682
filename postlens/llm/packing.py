"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

Pieces are placed one after the other, the longest first. Let N(g) be the number of open sequences
with g free places; a piece of size s goes to the gap for which the sum of
N(g)^2 becomes smallest, where a new sequence is a gap as long as a sequence and
a full sequence no longer counts. That needs nothing but the counts N(g) and, for
each gap, a stack of the sequences that have it.

Only sizes take part. They are dealt into groups of bounded size at random; each
group is packed by itself, and then the pieces of the sequences that stayed
clearly open are packed once more, together, in fewer groups.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.common import map_texts, per_task, raw, texts
from postlens.llm.tokens import word_ids
from postlens.runtime import stage

# Pieces in a group on average, and the free share of a sequence beyond which its pieces get a second turn.
GROUP_PIECES, OPEN_SHARE = 100_000, 0.02


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset of each of ``sizes``, which are 1 to ``capacity``, in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # by gap; a gap of 0 is never counted
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, opened = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    no = np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        # the sum grows by 2 (N(g - s) - N(g) + 1) if a gap g becomes g - s, by 1 - 2 N(g) if it closes
        grows = count[: capacity + 1 - size] - count[size:]
        grows = np.where(count[size:] > 0, 2 * grows + 2, no)
        if count[size]:
            grows[0] = 1 - 2 * count[size]
        new = 2 * count[capacity - size] + 1 if size < capacity else 0
        best = int(grows.argmin())
        if grows[best] <= new:
            gap = best + size
            place = waiting[gap].pop()
            count[gap] -= 1
        else:
            gap, place = capacity, opened
            opened += 1
        sequence[i], offset[i] = place, capacity - gap
        if gap > size:
            waiting[gap - size].append(place)
            count[gap - size] += 1
    return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, piece, start, length, ids, ids_crc32``: whole texts as ids and ``end_id``, longer ones cut.

    Staged, so that ``row`` names a piece for good.
    """

    @per_task
    def begin():
        words = word_ids(tokenizer)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

        def work(batch):
            doc, piece, start, ids = [], [], [], []
            for one, content in zip(batch.column("doc_id").to_pylist(), raw(batch), strict=True):
                found = words.text(content) + end
                cuts = range(0, len(found) // 4, capacity)
                doc += [one] * len(cuts)
                piece += range(len(cuts))
                start += cuts
                ids += [found[4 * x : 4 * (x + capacity)] for x in cuts]
            return {
                "doc_id": pa.array(doc, pa.int64()),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            }

        return work

    found = map_texts(texts(docs, doc_id, text), begin, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long")
    return stage(found.withColumn("row", F.monotonically_increasing_id()), "pieces")


def _packed(sizes: DataFrame, capacity: int, total: int, label: str) -> DataFrame:
    """``row, length, sequence_id, offset`` of ``row, length``: one pass of packing in groups."""
    groups = max(1, -(-total // GROUP_PIECES))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row"], ascending=[False, True])
        group = int(frame["bucket"].iloc[0])
        sequence, offset = sum_of_squares(frame["length"].to_numpy(), capacity)
        return pd.DataFrame({"row": frame["row"], "length": frame["length"], "sequence_id": sequence * groups + group, "offset": offset})

    mixed = F.xxhash64("row")
    dealt = sizes.select("row", "length", F.pmod(mixed, F.lit(groups)).alias("bucket"))
    packed = dealt.groupBy("bucket").applyInPandas(pack, "row long, length long, sequence_id long, offset long")
    return stage(packed, label)


def pack(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """``row, sequence_id, offset`` of ``row, length`` (lengths from 1 to ``capacity``); row must be unique.

    Full pieces are sequences by themselves. Others go through two passes, see above.
    """
    full = sizes.where(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = sizes.where(F.col("length") < capacity)
    total = open_.count()
    first = _packed(open_, capacity, total, "packed")
    filled = stage(first.groupBy("sequence_id").agg(F.sum("length").alias("filled")), "filled")
    slack = filled.where(F.col("filled") < capacity * (1 - OPEN_SHARE)).select("sequence_id")
    done = first.join(slack, "sequence_id", "left_anti").select("row", "sequence_id", "offset")
    again = stage(first.join(slack, "sequence_id", "left_semi").select("row", "length"), "open-pieces")
    second = _packed(again, capacity, again.count(), "packed-again")
    # numbers of the passes do not meet: even ones, odd ones, negative ones
    return full.unionByName(done.withColumn("sequence_id", F.col("sequence_id") * 2)).unionByName(
        second.select("row", (F.col("sequence_id") * 2 + 1).alias("sequence_id"), "offset")
    )


def packed_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Each piece with its place: ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``.

    Null texts are empty (the end id alone); without an end id an empty text has
    no piece. Repeated rows and null ids are packed like any other. A text longer
    than ``capacity`` is cut into pieces of that length and a rest. An empty
    table gives an empty result. Without ``with_ids`` the ids are not moved.
    """
    own = pieces(docs, tokenizer, capacity, end_id, doc_id, text)
    placed = pack(own.select("row", "length"), capacity)
    kept = own if with_ids else own.drop("ids")
    return kept.join(placed, "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` (uint32 bytes): the sequences themselves, of ``packed_pieces``."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("offset")
        return pd.DataFrame({"sequence_id": frame["sequence_id"].iloc[:1], "n_tokens": [frame["length"].sum()], "ids": [b"".join(frame["ids"])]})

    return packed.select("sequence_id", "offset", "length", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, n_tokens long, ids binary")
