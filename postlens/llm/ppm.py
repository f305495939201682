"""Language-model scores by prediction by partial matching over byte contexts.

A text is the bytes of its lower-cased (A-Z) UTF-8 form and one end symbol; before
it stands a run of that symbol (0xFF, which UTF-8 never holds). Each byte is coded
after its last ``ORDER`` bytes. If the context has been seen with the byte, the byte
has the share (n - d) / T there, T being the context's count and D its distinct
bytes; else an escape of d D / T is paid and the next shorter context is asked, where the bytes already ruled out no longer count, neither in T nor in D (symbol
exclusion). A shorter context counts a byte only where it was new to the longer one
(update exclusion): n is there the number of distinct longer contexts with the byte.
Below the empty context all bytes left are equally likely. d is
ESCAPE (1/2 would be method D; less is better where most contexts have few followers).

*Pretrained* scores: the trie of all contexts of the training documents is a set of
tables, one per length, keyed by context and byte. Windows of a context and its byte
are counted within blocks of documents, summed over the corpus, and valued level by
level: a window's value needs only the window one byte shorter, of which it is one of
256 extensions at most, and sums over its own context, 256 rows at most. No key is
hot, and no table is broadcast or held by one task. The values go back to the blocks.

*Adaptive* scores: each document starts from nothing and learns while it is coded.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.llm.common import map_texts, raw, texts
from postlens.runtime import stage

ORDER, ESCAPE = 5, 0.25
END = b"\xff"
# Bytes of text in a block, and in the runs in which its windows are read. A task holds a block with
# its words, its windows and their values, some twenty times its bytes.
BLOCK_BYTES, RUN_BYTES = 8 << 20, 1 << 19
# Parts into which requests are dealt: one for so many blocks, within these bounds.
BLOCKS_PER_PART, LEAST_PARTS, PARTS = 2, 16, 4096
# Blocks of a file: Spark reads what a row group has of a nested column at once.
BLOCKS_PER_FILE = 2
# Windows whose values a task deals into parts at once.
DEALT = 1 << 20


def windows(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte to code with the ORDER bytes before it, as one number, and the number of them in each text."""
    pad = END * ORDER
    data = np.frombuffer(b"".join(pad + t + END for t in coded), np.uint8)
    keys = np.zeros(len(data) - ORDER, np.int64)
    for i in range(ORDER + 1):
        keys = (keys << 8) | data[i : len(data) - ORDER + i]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
    ends = np.cumsum(lengths + ORDER)
    real = np.ones(len(keys), bool)
    for step in range(ORDER):  # the next text's run of end symbols is not coded
        at = ends[:-1] + step - ORDER
        real[at] = False
    return keys[real], lengths


def folded(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


class Trie:
    """A context trie in memory: adaptive scores, and the pretrained ones of small corpora."""

    def __init__(self, order: int = ORDER):
        self.order, self.nodes = order, {}

    def add(self, before: bytes, symbol: int) -> None:
        for length in range(self.order, -1, -1):
            node = self.nodes.setdefault(before[len(before) - length :], {})
            node[symbol] = node.get(symbol, 0) + 1
            if node[symbol] > 1:
                break

    def value(self, before: bytes, symbol: int) -> float:
        """log10 of the probability of ``symbol`` after ``before``."""
        total, excluded = 0.0, {}
        for length in range(self.order, -1, -1):
            node = self.nodes.get(before[len(before) - length :], {})
            left = {s: n for s, n in node.items() if s not in excluded}
            if not left:
                continue
            all_ = sum(left.values())
            if symbol in left:
                return total + math.log10((left[symbol] - ESCAPE) / all_)
            total += math.log10(ESCAPE * len(left) / all_)
            excluded = node
        return total - math.log10(256 - len(excluded))

    def code(self, text: bytes, learn: bool) -> float:
        """log10 of the probability of the text and its end, learning on the way if asked to."""
        data, total = END * self.order + folded(text) + END, 0.0
        for at in range(self.order, len(data)):
            before, symbol = data[at - self.order : at], data[at]
            total += self.value(before, symbol)
            if learn:
                self.add(before, symbol)
        return total


def adaptive_scores(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score``: log10 of each text's probability by a model that starts empty and learns while it codes.

    Null texts are empty; repeated rows get a row each.
    """

    def work(batch):
        return {"doc_id": batch.column("doc_id"), "score": [Trie(order).code(t, True) for t in raw(batch)]}

    return map_texts(texts(docs, doc_id, text), work, "doc_id long, score double")


class Block:
    """A block's words and windows. Numbers follow from the texts alone, so a second reading gives the same ones."""

    def __init__(self, block_texts: list[bytes]):
        self.texts = []
        words: dict[bytes, int] = {}
        self.codes = []
        for text in block_texts:
            own = text.lower().split()  # of bytes: A-Z, and x20, x09-x0D
            self.texts.append(b" ".join(own))
            self.codes.append(np.fromiter((words.setdefault(w, len(words)) for w in own), np.int32, len(own)))
        self.words = list(words)
        self._runs = self._cut()

    def _cut(self) -> list[slice]:
        runs, start, size = [], 0, 0
        for i, text in enumerate(self.texts):
            if size and size + len(text) > RUN_BYTES:
                runs.append(slice(start, i))
                start, size = i, 0
            size += len(text)
        return [*runs, slice(start, len(self.texts))] if self.texts else []

    def word_counts(self, chosen: np.ndarray) -> np.ndarray:
        held = [codes for codes, take in zip(self.codes, chosen.tolist(), strict=True) if take]
        return np.bincount(np.concatenate(held), minlength=len(self.words)) if held else np.zeros(len(self.words), np.int64)

    def read_runs(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """For each run of texts: its place, its distinct windows, the number of each window's, and the texts' lengths."""
        for run in self._runs:
            keys, lengths = windows(self.texts[run])
            codes, distinct = pd.factorize(keys)
            yield run, distinct, codes.astype(np.int32), lengths

    def window_counts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct windows, sorted, and how often the chosen texts hold them."""
        sums = _Sums()
        for run, distinct, codes, lengths in self.read_runs():
            weight = np.repeat(chosen[run], lengths)
            sums.add(distinct, np.bincount(codes[weight], minlength=len(distinct)))
        return sums.result()


class _Sums:
    """Counts by key, merged run by run: what has come since the last merge is at most as long as the result."""

    def __init__(self):
        self.keys, self.counts, self.new, self.size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((keys, counts))
        self.size += len(keys)
        if self.size > max(len(self.keys), 1 << 18):
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.new]])
        counts = np.concatenate([self.counts, *[c for _, c in self.new]])
        self.new, self.size = [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            self._merge()
        return self.keys, self.counts


def _part_of_words(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(parts)


def _part_of_windows(keys: np.ndarray, parts: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)) % np.uint64(parts)


def _squeezed(data: bytes) -> bytes:
    """``data`` after its length, compressed more than a shuffle would."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _loosened(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _planes(values: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes, and so on, where equal ones stand together; compressed."""
    return _squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def _of_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_loosened(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed_words(words: list[bytes]) -> bytes:
    return _squeezed(b"\n".join(words))


def _words_of(data: bytes) -> list[bytes]:
    return _loosened(data).split(b"\n")


def _packed_keys(keys: np.ndarray) -> bytes:
    """Windows in ascending order, as their distances."""
    return _planes(np.diff(keys, prepend=0))


def _keys_of(data: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(data, np.int64))


def _blocks(docs: DataFrame) -> DataFrame:
    """``block, doc_ids, learn, sizes, texts``: the documents in blocks of about BLOCK_BYTES, one row each; the texts' bytes are packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, learn, held, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            row = {"doc_ids": pa.array([ids], pa.list_(pa.int64())), "learn": pa.array([learn], pa.list_(pa.bool_()))}
            row |= {"sizes": pa.array([list(map(len, held))], pa.list_(pa.int32())), "texts": pa.array([_squeezed(b"".join(held))], pa.binary())}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for one, take, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "learn")), raw(batch), strict=True):
                if held and size + len(text) > BLOCK_BYTES:
                    yield out()
                    ids, learn, held, size = [], [], [], 0
                ids.append(one)
                learn.append(take)
                held.append(text)
                size += len(text)
        if held:
            yield out()

    return docs.mapInArrow(pack, "doc_ids array<long>, learn array<boolean>, sizes array<int>, texts binary").withColumn("block", F.monotonically_increasing_id())


def _block_of(batch: pa.RecordBatch, row: int) -> tuple[Block, np.ndarray]:
    ends = np.cumsum([0, *batch.column("sizes")[row].as_py()]).tolist()
    data = _loosened(batch.column("texts")[row].as_py())
    return Block([data[a:b] for a, b in zip(ends, ends[1:])]), np.array(batch.column("learn")[row].as_py(), bool)  # noqa: B905


_REQUEST = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
REQUEST = "block long, part int, kind int, keys binary, counts binary"
WORDS, WINDOWS = 0, 1


def _requests(blocks: DataFrame, parts: int) -> DataFrame:
    """What each block holds: its words and windows with their counts in training texts, dealt into parts by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, learn = _block_of(batch, row)
                rows = []
                own, counts = np.array(block.words, object), block.word_counts(learn)
                part = _part_of_words(block.words, parts)
                for p, at in _grouped(part, parts):
                    rows.append((p, WORDS, _packed_words(own[at].tolist()), _planes(counts[at].astype(np.int32))))
                keys, counts = block.window_counts(learn)
                for p, at in _grouped(_part_of_windows(keys, parts), parts):
                    rows.append((p, WINDOWS, _packed_keys(keys[at]), _planes(counts[at].astype(np.int32))))
                if rows:
                    number = batch.column("block")[row].as_py()
                    p, kind, key, count = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([number] * len(p), p, kind, key, count), _REQUEST, strict=True)], schema=_REQUEST)

    return blocks.select("block", "learn", "sizes", "texts").mapInArrow(run, REQUEST)


def _grouped(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        yield p, order[bounds[p] : bounds[p + 1]]


def _word_dictionary(requests: DataFrame) -> DataFrame:
    """``part, words, counts, total, distinct``: one row per part with all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> pa.RecordBatch:
            counts = np.fromiter(held.values(), np.int64, len(held))
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([now], pa.int32()),
                    "keys": pa.array([_packed_words(list(held))], pa.binary()),
                    "counts": pa.array([_planes(counts)], pa.binary()),
                    "total": [int(counts.sum())],
                    "known": [int((counts > 0).sum())],
                }
            )

        for batch in batches:
            for part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts")), strict=True):
                if part != now:
                    if held:
                        yield out()
                    now, held = part, {}
                for word, n in zip(_words_of(keys), _of_planes(counts, np.int32).tolist(), strict=True):
                    held[word] = held.get(word, 0) + n
        if held:
            yield out()

    rows = requests.where(F.col("kind") == WORDS).select("part", "keys", "counts")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, keys binary, counts binary, total long, known long")


def _window_sums(requests: DataFrame) -> DataFrame:
    """``key, n`` of all windows of the corpus, those that no training text holds with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sums = None, np.empty(0, np.int64), np.empty(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, distinct = pd.factorize(np.concatenate([keys, *more_keys]))
            return distinct, np.bincount(codes, weights=np.concatenate([sums, *more_sums]), minlength=len(distinct)).astype(np.int64)

        more_keys, more_sums = [], []
        for batch in batches:
            for part, own, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts")), strict=True):
                if part != now:
                    if now is not None:
                        keys, sums = merged()
                        yield pa.RecordBatch.from_pydict({"key": keys, "n": sums})
                    now, keys, sums, more_keys, more_sums = part, np.empty(0, np.int64), np.empty(0, np.int64), [], []
                more_keys.append(_keys_of(own))
                more_sums.append(_of_planes(counts, np.int32))
                if sum(map(len, more_keys)) > 1 << 20:
                    keys, sums = merged()
                    more_keys, more_sums = [], []
        if now is not None:
            keys, sums = merged()
            yield pa.RecordBatch.from_pydict({"key": keys, "n": sums})

    rows = requests.where(F.col("kind") == WINDOWS).select("part", "keys", "counts")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "key long, n long")


def window_values(sums: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, value``: log10 of the probability of each window's byte after its context.

    ``sums(key, n)`` must hold distinct keys of ``order`` context bytes and the byte.
    """
    seen = F.when(F.col("n") > 0, F.lit(1)).otherwise(F.lit(0))
    levels = [sums.select("key", "n")]
    for length in range(order - 1, -1, -1):
        mask = (1 << 8 * (length + 1)) - 1
        shorter = levels[0].groupBy(F.col("key").bitwiseAND(F.lit(mask).cast("long")).alias("key")).agg(F.sum(seen).alias("n"))
        levels.insert(0, stage(shorter, f"windows-{length}"))
    context = F.shiftright("key", 8)

    def over(value: Column) -> Column:
        return F.sum(value).over(Window.partitionBy("context"))

    # the level of no context: what is not seen there shares what is left evenly
    first = levels[0].withColumn("context", context)
    first = first.select("key", "n", over(F.col("n")).alias("total"), over(seen).alias("kinds"))
    valued = stage(first.withColumn("below", -F.log10(F.greatest(F.lit(256) - F.col("kinds"), F.lit(1)))), "valued-0")
    for length in range(1, order + 1):
        mask = (1 << 8 * length) - 1
        up = valued.select(F.col("key").alias("up_key"), *[F.col(c).alias(f"up_{c}") for c in ("n", "total", "kinds", "below")])
        rows = levels[length].withColumn("up_key", F.col("key").bitwiseAND(F.lit(mask).cast("long"))).join(up, "up_key")
        rows = rows.withColumn("context", context).select(
            "key", "n", "up_n", "up_total", "up_kinds", "up_below",
            over(F.col("n")).alias("total"),
            over(seen).alias("kinds"),
            over(F.when(F.col("n") > 0, F.col("up_n")).otherwise(0)).alias("excluded"),
        )
        new = F.col("up_kinds") - F.col("kinds")
        left = F.col("up_total") - F.col("excluded")
        below = F.when(new <= 0, F.col("up_below")).when(F.col("up_n") > 0, F.log10((F.col("up_n") - ESCAPE) / left)).otherwise(F.log10(ESCAPE * new / left) + F.col("up_below"))
        valued = stage(rows.select("key", "n", "total", "kinds", below.alias("below")), f"valued-{length}")
    all_ = F.col("total")
    value = F.when(all_ <= 0, F.col("below")).when(F.col("n") > 0, F.log10((F.col("n") - ESCAPE) / all_)).otherwise(F.log10(ESCAPE * F.col("kinds") / all_) + F.col("below"))
    return valued.select("key", value.alias("value"))


_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("values", pa.binary())])
ANSWER = "block long, part int, kind int, values binary"


def _answers(requests: DataFrame, words: DataFrame, values: DataFrame, parts: int) -> DataFrame:
    """The requests' words and windows replaced by the corpus's counts and values, in their order.

    A part's dictionary comes first, then its requests; a task holds one part's at a time.
    """
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, found = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys, found = keys[order], found[order]
            rows = [(p, _packed_keys(keys[at]), _planes(found[at])) for p, at in _grouped(_part_of_windows(keys, parts), parts)]
            p, own, values = zip(*rows, strict=True)
            return pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "keys": pa.array(own, pa.binary()), "counts": pa.array(values, pa.binary())})

        for batch in batches:
            held.append((batch.column("key").to_numpy(zero_copy_only=False), batch.column("value").to_numpy(zero_copy_only=False).astype(np.float32)))
            size += batch.num_rows
            if size >= DEALT:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, table = None, {}, []
        for batch in batches:
            rows = []
            for part, kind, block, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "block", "keys", "counts")), strict=True):
                if (part, kind) != now:
                    now, known, table = (part, kind), {}, []
                if block < 0:
                    if kind == WORDS:
                        known.update(zip(_words_of(keys), _of_planes(counts, np.int64).tolist(), strict=True))
                    else:
                        table.append((_keys_of(keys), _of_planes(counts, np.float32)))
                    continue
                if kind == WORDS:
                    own = _words_of(keys)
                    found = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                else:
                    if not isinstance(known, tuple):
                        every = np.concatenate([k for k, _ in table])
                        order = np.argsort(every)
                        known = every[order], np.concatenate([v for _, v in table])[order]
                    found = known[1][np.searchsorted(known[0], _keys_of(keys))]
                rows.append((block, part, kind, _planes(found)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ANSWER, strict=True)], schema=_ANSWER)

    window_rows = values.mapInArrow(dealt, "part int, keys binary, counts binary")
    dictionary = words.select("part", F.lit(WORDS).alias("kind"), "keys", "counts").unionByName(window_rows.select("part", F.lit(WINDOWS).alias("kind"), "keys", "counts"))
    both = dictionary.withColumn("block", F.lit(-1).cast("long")).unionByName(requests.select("part", "kind", "keys", "counts", "block"))
    return both.repartition("part", "kind").sortWithinPartitions("part", "kind", "block").mapInArrow(run, ANSWER)


def scores(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pretrained scores of every row, the model being made of the rows for which ``learn`` holds.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    ``score`` is log10 of the model's probability of the text, see above. ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the words and
    one end; c, N and V are the training words' count, sum and number of distinct
    ones, ends included. A null text is empty: one end. ``learn`` null counts as
    false. Without training rows N is 0 and every byte is equally likely. Repeated rows
    count each time; texts are read whole; an empty table gives an empty result.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = stage(_blocks(own), "blocks", BLOCKS_PER_FILE)
    parts = min(PARTS, max(LEAST_PARTS, -(-blocks.select("block").count() // BLOCKS_PER_PART)))
    requests = stage(_requests(blocks, parts), "requests", 2 * parts * BLOCKS_PER_FILE)
    words = stage(_word_dictionary(requests), "words")
    ends = blocks.select(F.sum(F.size(F.filter("learn", lambda x: x))).alias("n")).first()["n"] or 0
    sums = words.agg(F.sum("total").alias("total"), F.sum("known").alias("known")).first()
    total, known = (sums["total"] or 0) + ends, (sums["known"] or 0) + (1 if ends else 0)
    values = window_values(stage(_window_sums(requests), "window-sums"))
    answers = _answers(requests, words, values, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {WORDS: [], WINDOWS: []}
        for batch in batches:
            for row in range(batch.num_rows):
                number, part, kind = (batch.column(c)[row].as_py() for c in ("block", "part", "kind"))
                if number != now:
                    now, held = number, {WORDS: [], WINDOWS: []}
                if kind < 2:
                    held[kind].append((part, batch.column("values")[row].as_py()))
                    continue
                block, learned = _block_of(batch, row)
                ids = batch.column("doc_ids")[row].as_py() or []
                yield _scored(block, ids, learned, held, parts, total, known, ends)

    sent = answers.select("block", "part", "kind", "values").withColumn("doc_ids", F.lit(None).cast("array<long>")).withColumn("learn", F.lit(None).cast("array<boolean>")).withColumn("sizes", F.lit(None).cast("array<int>")).withColumn("texts", F.lit(None).cast("binary"))
    back = blocks.select("block", F.lit(0).alias("part"), F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("values"), "doc_ids", "learn", "sizes", "texts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sent.unionByName(back).repartition("block").sortWithinPartitions("block", "kind", "part").mapInArrow(run, schema)


def _scored(block: Block, ids: list, learned: np.ndarray, held: dict, parts: int, total: int, known: int, ends: int) -> pa.RecordBatch:
    counts = np.zeros(len(block.words), np.int64)
    place = dict(_grouped(_part_of_words(block.words, parts), parts))
    for part, blob in held[WORDS]:
        counts[place[part]] = _of_planes(blob, np.int64)
    scale = math.log10(total + 0.1 * (known + 1))
    worth = np.log10(counts + 0.1) - scale
    end = math.log10(ends + 0.1) - scale
    base = np.array([float(worth[c].sum()) + end for c in block.codes])
    tokens = np.array([len(c) + 1 for c in block.codes], np.int64)
    found = np.array([int((counts[c] > 0).sum()) + (ends > 0) for c in block.codes], np.int64)
    # all windows of the block, in the order in which they were asked for; the runs are read again rather than held
    every, _ = block.window_counts(np.zeros(len(block.texts), bool))
    value = np.empty(len(every))
    place = dict(_grouped(_part_of_windows(every, parts), parts))
    for part, blob in held[WINDOWS]:
        value[place[part]] = _of_planes(blob, np.float32)
    score = np.empty(len(block.texts))
    for run, distinct, codes, lengths in block.read_runs():
        per_byte = value[np.searchsorted(every, distinct)][codes]
        score[run] = np.add.reduceat(per_byte, np.cumsum(lengths) - lengths)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "held_out": pa.array(~learned),
            "n_tokens": pa.array(tokens),
            "n_known": pa.array(found),
            "train_tokens": pa.array(np.full(len(ids), total, np.int64)),
            "base_score": pa.array(base),
            "score": pa.array(score),
        }
    )
