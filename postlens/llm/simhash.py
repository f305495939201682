"""SimHash near-duplicates with a hierarchical index in Gray order.

Distinct fingerprints are sorted by their rank in the Gray code, where
neighbours differ in few bits, and cut into blocks. A block, and within it each
group of 512, 64 and 8 neighbours, is an index node: the mask of the bits on
which all its members agree, and their pattern. Two nodes whose agreed bits
differ in more than the limit are dropped with everything below them; two nodes
that can differ in no more bits than the limit are linked as a whole. Only what
is left goes down to the next level, the last being single fingerprints.

The blocks' masks and patterns form a directory of bounded size; pairs of blocks
that survive there are compared in parallel, one task each, and send back a
spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.common import hex64, linked_groups, map_texts, raw, texts
from postlens.runtime import stage

# Fingerprints in a block at least, and blocks in the directory at most (but for one block per partition).
BLOCK, DIRECTORY = 65_536, 65_536
FANOUT = 8
# Node pairs examined at once, counted after their nodes have been opened on both sides: about 40 MB of indexes and patterns.
FRONTIER = 1 << 20
# Partners of a block that are sent with its codes in one frame (half a MB each).
PARTNERS = 32
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text in UTF-8; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()  # on bytes: A-Z, and the white space x20, x09-x0D
    if not words:
        return np.empty(0, np.uint64)
    line, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_ = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([hash_(line[s:e], SEED) for s, e in spans], dtype=np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (long) of ``doc_id, text``."""

    def work(batch):
        found = np.array([fingerprint(t, shingle) for t in raw(batch)], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fingerprint": pa.array(found.view(np.int64))}

    return map_texts(docs, work, "doc_id long, fingerprint long")


def gray_rank(code: Column) -> Column:
    """The place of ``code`` in the Gray sequence, as a long whose signed order is the order of the places."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(2**63)))


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Masks and patterns from the single codes up to one node; node i holds FANOUT nodes from FANOUT * i."""
    levels = [(np.full(len(codes), ~np.uint64(0)), codes)]
    while len(levels[-1][0]) > 1:
        mask, pattern = levels[-1]
        at = np.arange(0, len(mask), FANOUT)
        differ = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[at], FANOUT)[: len(mask)], at)
        shared = np.bitwise_and.reduceat(mask, at) & ~differ
        levels.append((shared, pattern[at] & shared))
    return levels


class _Groups:
    """Sets of places that are linked; the root is the smallest place."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root[:] = root[root]


def spanning_links(left: np.ndarray, right: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever pairs at ``limit`` or fewer bits connect, between and within two sorted blocks.

    With ``right`` the pairs between the blocks count, else those within ``left``.
    """
    codes = left if right is None else np.concatenate((left, right))
    shift = 0 if right is None else len(left)
    groups = _Groups(len(codes))
    one = _levels(left)
    two = one if right is None else _levels(right)
    tops = len(one) - 1, len(two) - 1
    start = np.zeros(1, np.int64)
    stack = [(*tops, start, start)]
    while stack:
        up, down, a, b = stack.pop()
        if len(a) > FRONTIER // FANOUT**2:
            half = len(a) // 2
            stack += [(up, down, a[half:], b[half:]), (up, down, a[:half], b[:half])]
            continue
        (mask_a, pattern_a), (mask_b, pattern_b) = one[up], two[down]
        both = mask_a[a] & mask_b[b]
        fixed = np.bitwise_count((pattern_a[a] ^ pattern_b[b]) & both)
        most = fixed + np.bitwise_count(~both)
        if not up and not down:
            near = fixed <= limit
            groups.link(a[near], b[near] + shift)
            continue
        # a pair of nodes whose members all lie close together is linked through its first members
        whole = most <= limit
        if whole.any():
            for side, level, own in ((a, up, 0), (b, down, shift)):
                size = len(left) if not own else len(codes) - shift
                first, stop = side[whole] * FANOUT**level, np.minimum((side[whole] + 1) * FANOUT**level, size)
                for s, e in np.unique(np.stack((first, stop)), axis=1).T.tolist():
                    groups.link(np.arange(s + 1, e) + own, np.full(e - s - 1, s + own))
            groups.link(a[whole] * FANOUT**up, b[whole] * FANOUT**down + shift)
        open_ = (fixed <= limit) & ~whole
        a, b = a[open_], b[open_]
        if up >= down:
            steps, up = np.arange(FANOUT), up - 1
            a, b = (a[:, None] * FANOUT + steps).ravel(), np.repeat(b, FANOUT)
            inside = a < len(one[up][0])
            a, b = a[inside], b[inside]
        if down > up:
            steps, down = np.arange(FANOUT), down - 1
            b, a = (b[:, None] * FANOUT + steps).ravel(), np.repeat(a, FANOUT)
            inside = b < len(two[down][0])
            a, b = a[inside], b[inside]
        if right is None:  # each pair of nodes once
            once = a <= b if up == down else np.full(len(a), True)
            a, b = a[once], b[once]
        if len(a):
            stack.append((up, down, a, b))
    far = np.flatnonzero(groups.root != np.arange(len(codes)))
    return codes[far], codes[groups.root[far]]


def _blocks(codes: DataFrame, block: int) -> DataFrame:
    """``part, number, mask, pattern, codes`` of ``fingerprint``, sorted in Gray order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = np.empty(0, np.int64), 0

        def out(own: np.ndarray) -> pa.RecordBatch:
            mask, pattern = (x[0] for x in _levels(own.view(np.uint64))[-1])
            columns = [[number], np.array([mask]).view(np.int64), np.array([pattern]).view(np.int64), [own.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3], pa.binary())], ["number", "mask", "pattern", "codes"])

        for batch in batches:
            held = np.concatenate((held, batch.column(0).to_numpy(zero_copy_only=False)))
            while len(held) >= block:
                yield out(held[:block])
                held, number = held[block:], number + 1
        if len(held):
            yield out(held)

    return codes.mapInArrow(pack, "number long, mask long, pattern long, codes binary")


def near_links(codes: DataFrame, limit: int = 3, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between distinct ``fingerprint`` values that connect all that are ``limit`` or fewer bits apart."""
    spark = codes.sparkSession
    total = codes.count()
    block = max(block, -(-total // DIRECTORY))
    ranked = codes.select("fingerprint", gray_rank(F.col("fingerprint")).alias("rank"))
    ranked = ranked.repartitionByRange(max(1, -(-total // block)), "rank").sortWithinPartitions("rank").select("fingerprint")
    blocks = stage(_blocks(ranked, block).withColumn("block", F.monotonically_increasing_id()), "gray-blocks")
    # masks and patterns only: at most DIRECTORY rows and one for each partition of the sort, 24 bytes each
    directory = blocks.select("block", "mask", "pattern").orderBy("block").toPandas()
    known = spark.sparkContext.broadcast([directory[c].to_numpy() for c in ("block", "mask", "pattern")])

    def partners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, masks, patterns = (x.view(np.uint64) if i else x for i, x in enumerate(known.value))
        for frame in frames:
            for own, mask, pattern, codes_ in frame.itertuples(index=False):
                both = masks & np.array([mask]).view(np.uint64)
                near = np.bitwise_count((patterns ^ np.array([pattern]).view(np.uint64)) & both) <= limit
                others = ids[near]
                for at in range(0, len(others), PARTNERS):
                    some = others[at : at + PARTNERS]
                    yield pd.DataFrame({"low": np.minimum(some, own), "high": np.maximum(some, own), "block": own, "codes": [codes_] * len(some)})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        one, *rest = [np.frombuffer(x, np.uint64) for x in frame["codes"]]
        a, b = spanning_links(one, rest[0] if rest else None, limit)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    pairs = blocks.select("block", "mask", "pattern", "codes").mapInPandas(partners, "low long, high long, block long, codes binary")
    return pairs.groupBy("low", "high").applyInPandas(compare, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, limit: int = 3, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed
    42) of the text's shingles, repeats included; a text of fewer words than a
    shingle is one shingle. Null, empty and blank texts have fingerprint 0,
    linked like any other. Two fingerprints link at ``limit`` or fewer differing
    bits; ``component_id`` is the smallest doc_id that can be reached. Repeated
    rows keep a row each. Null ids are smaller than none: a group of null ids
    only has a null ``component_id``. An empty table gives an empty result.
    """
    rows = stage(fingerprints(texts(docs, doc_id, text), shingle), "fingerprints")
    codes = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "codes")
    links = near_links(codes.select("fingerprint"), limit, block)
    roots = stage(linked_groups(links, "simhash"), "roots")
    placed = stage(codes.join(roots, codes.fingerprint == roots.node, "left").select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")), "placed")
    least = stage(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    found = stage(placed.join(least, "root").select("fingerprint", "component_id"), "components")
    return rows.join(found, "fingerprint").select("doc_id", hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, limit: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all its columns, of each group the document with its smallest doc_id.

    Rows without an id cannot be named by a decision and stay; rows that repeat
    an id count as one document.
    """
    groups = simhash_groups(docs, shingle, limit, doc_id, text)
    drop = stage(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct(), "dropped")
    return docs.join(drop, F.col(f"`{doc_id}`").cast("long") == F.col("__id"), "left_anti")
