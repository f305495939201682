"""Phrase collocations from count streams in prefix and suffix order.

A text is lower-cased (A-Z), cut into pieces at punctuation and line ends, and these
into words at blanks. All is counted per language.

1. One reading counts the words, and the pairs of neighbours in a *sketch*: an array of
   bounded size whose slots, chosen by hash, never count too little. A phrase whose slot
   stays below the least count cannot be a candidate. A second reading does the same for
   longer phrases whose pairs passed. The sketches only save work; no count is taken
   from them.
2. A third reading takes from each place the longest *window* of at most ``longest``
   words whose beginnings, and those of the window one word on, all passed. Equal windows of a task are added up and the windows
   brought into prefix order by range. A walk over the sorted stream adds up all
   beginnings of a window at once: those of the window before that go on stay open, the
   others are complete. What a range's first and last window begin with may go on in a
   neighbouring range, so these sums leave as parts and are added afterwards.
3. The stream of frequent phrases is walked in prefix order: the phrases that a phrase
   begins with stand before it, still open, which gives the left counts of all its cuts,
   and each phrase tells the one that it prolongs by a word. The same walk over the
   reversed words gives the right counts and the extensions to the left. Ranges borrow
   the at most ``longest - 1`` open phrases that lie in the range before.

No count goes through a hash table over the corpus, no phrase or word has to fit
anywhere as a whole, and every broadcast but the sketch's bits has a checked size.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.llm.common import slices
from postlens.runtime import small_side, stage

NO_LANG = "und"
# Slots of the sketch: one for so many bytes of text, within these bounds (bits, so 128 MB of counters in a task and 16 MB
# of bits at most). Beyond that more windows pass that have to be sorted, and the counts stay what they are.
BYTES_A_SLOT, LEAST_BITS, MOST_BITS, CHUNK_BITS = 64, 16, 27, 16
# Bytes of text that a task takes apart at once.
SLICE = 2 << 20
# Bytes of text for one range of windows, and to find the ranges' borders by.
RANGE_BYTES, SAMPLE = 32 << 20, 2 << 20
# Different words or windows that a task adds up before it passes them on.
HELD = 200_000

_PIECES = re.compile(rb"[.,;:!?\n-\r]")


def pieces(text: bytes) -> list[list[bytes]]:
    """The words of each piece of a text in UTF-8."""
    # bytes.split() takes x20 and x09-x0D for blanks; after the cut only x20 and x09 are left of these
    return [own for piece in _PIECES.split(text.lower()) if (own := piece.split())]


def _documents(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("text")).where("text is not null and text <> ''")


class _Numbers(dict):
    """Numbers of a language's words in the order of their first use, and a hash of each."""

    def __init__(self, lang: str):
        super().__init__()
        self.words, self.hashes, self.seed = [], [], xxhash.xxh64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return number


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[str, _Numbers, np.ndarray]]:
    """For each language of a batch its words and the texts as their numbers, -1 at the end of each piece."""
    texts, langs = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()
    found: dict[str, tuple[_Numbers, list]] = {}
    for text, lang in zip(texts, langs, strict=True):
        if lang not in found:
            found[lang] = _Numbers(lang), []
        numbers, codes = found[lang]
        for own in pieces(text):
            codes.extend(map(numbers.__getitem__, own))
            codes.append(-1)
    for lang, (numbers, codes) in found.items():
        yield lang, numbers, np.array(codes, np.int64)


def _slots(numbers: _Numbers, codes: np.ndarray, bits: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 2 words, 3 and so on: the places of ``codes`` where such a phrase begins, and the slots of these phrases.

    The receiver may send back which of the places go on.
    """
    hashes = np.array(numbers.hashes, np.uint64)
    at = np.flatnonzero(codes >= 0)
    mixed = hashes[codes[at]]
    ends = np.append(codes, np.full(longest, -1))
    for size in range(2, longest + 1):
        goes_on = ends[at + size - 1] >= 0
        at, mixed = at[goes_on], mixed[goes_on]
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[codes[at + size - 1]] + np.uint64(0x632BE59BD9B4E019))
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        passed = yield at, (mixed >> np.uint64(64 - bits)).astype(np.uint32)
        if passed is not None:
            at, mixed = at[passed], mixed[passed]


class _Sketch:
    """A task's counters. They stop at the least count that is asked for."""

    def __init__(self, bits: int, least: int):
        self.bits, self.least, self.counters = bits, least, None

    def add(self, slots: np.ndarray) -> None:
        if self.counters is None:
            self.counters = np.zeros(1 << self.bits, _small(self.least))
        slots.sort()
        first = np.flatnonzero(np.diff(slots, prepend=slots[:1] + np.uint32(1)))
        slots, seen = slots[first], np.diff(np.append(first, len(slots)))
        self.counters[slots] = np.minimum(self.counters[slots].astype(np.int64) + seen, self.least)

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        """Numbered parts that are not empty: which slots have been met, and their counts."""
        if self.counters is not None:
            for chunk, part in enumerate(self.counters.reshape(-1, min(1 << CHUNK_BITS, len(self.counters)))):
                met = part > 0
                if met.any():
                    yield chunk, zlib.compress(np.packbits(met).tobytes() + part[met].tobytes(), 1)


def _small(least: int) -> type:
    return np.uint8 if least < 256 else np.uint16 if least < 1 << 16 else np.uint32


def _unpacked(packed: bytes, bits: int, least: int) -> np.ndarray:
    own, size = zlib.decompress(packed), min(1 << CHUNK_BITS, 1 << bits)
    counts = np.zeros(size, np.int64)
    counts[np.unpackbits(np.frombuffer(own, np.uint8, size // 8)).astype(bool)] = np.frombuffer(own, _small(least), offset=size // 8)
    return counts


_COUNTED = "kind int, lang string, word string, n long, chunk int, counters binary"
WORD, SKETCH = 0, 1
_COUNTED_ARROW = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("chunk", pa.int32()), ("counters", pa.binary())])


def _chunk_rows(sketch: _Sketch) -> Iterator[pa.RecordBatch]:
    for chunk, packed in sketch.chunks():
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((SKETCH, None, None, None, chunk, packed), _COUNTED_ARROW, strict=True)], schema=_COUNTED_ARROW)


def _read_counts(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """Word counts and the sketch of pairs, each added up within a task."""

    def words(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            n = len(counts)
            columns = [np.full(n, WORD, np.int32), [lang] * n, pa.array(list(counts), pa.binary()).cast(pa.string()), list(counts.values()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _COUNTED_ARROW, strict=True)], schema=_COUNTED_ARROW)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held = _Sketch(bits, least), {}
        for batch in slices(batches, SLICE):
            for lang, numbers, codes in _sequences(batch):
                counts = held.setdefault(lang, Counter())
                for word, n in zip(numbers.words, np.bincount(codes[codes >= 0], minlength=len(numbers)).tolist(), strict=True):
                    counts[word] += n
                for _, slots in _slots(numbers, codes, bits, 2):
                    sketch.add(slots)
            if sum(map(len, held.values())) > HELD:
                yield from words(held)
        yield from words(held)
        yield from _chunk_rows(sketch)

    return docs.mapInArrow(run, _COUNTED)


def _read_longer(docs: DataFrame, pairs: np.ndarray, bits: int, least: int, longest: int) -> DataFrame:
    """The sketch of phrases of 3 words and more whose pairs all passed."""
    known = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = _Sketch(bits, least)
        for batch in slices(batches, SLICE):
            for _, numbers, codes in _sequences(batch):
                found = _slots(numbers, codes, bits, longest)
                at, slots = next(found)
                passed = _passes(known.value, slots)
                good = np.zeros(len(codes) + longest, bool)
                good[at[passed]] = True
                for size in range(3, longest + 1):
                    at, slots = found.send(passed)
                    passed = good[at + size - 2]  # the pair at the end; those before it have passed
                    sketch.add(slots[passed])
        yield from _chunk_rows(sketch)

    return docs.mapInArrow(run, _COUNTED)


def _frequent_slots(counted: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit for each slot of the sketch, packed: 2**bits / 8 bytes, whatever the corpus."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["chunk", "bits"])

        for batch in batches:
            for chunk, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = _unpacked(packed, bits, least)
                if chunk != now:
                    if now is not None:
                        yield out()
                    now, total = chunk, np.zeros(len(part), np.int64)
                total += part
        if now is not None:
            yield out()

    rows = counted.where(F.col("kind") == SKETCH).select("chunk", "counters").repartition("chunk").sortWithinPartitions("chunk")
    passed = np.zeros((1 << bits) // 8, np.uint8)
    size = min(1 << CHUNK_BITS, 1 << bits) // 8
    for row in rows.mapInArrow(add, "chunk int, bits binary").collect():
        passed[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return passed


def _passes(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (packed[slots >> np.uint32(3)] >> (7 - (slots & np.uint32(7))).astype(np.uint8) & 1).astype(bool)


def _windows_of(numbers: _Numbers, codes: np.ndarray, pairs: np.ndarray, longer: np.ndarray, bits: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The different windows of two words or more, filled up with -1, and how often each is found."""
    lengths = np.zeros(len(codes) + 1, np.int64)  # words from each place whose beginnings pass, 0 for a single one
    found = _slots(numbers, codes, bits, longest)
    at, slots = next(found)
    for size in range(2, longest + 1):
        passed = _passes(pairs if size == 2 else longer, slots)
        lengths[at[passed]] = size
        if size < longest:
            at, slots = found.send(passed)
    # what follows the first word has to pass as well
    lengths[:-1] = np.minimum(lengths[:-1], np.maximum(lengths[1:], 1) + 1)
    start = np.flatnonzero(lengths > 1)
    table = np.full((len(start), longest), -1, np.int64)
    for i in range(longest):
        open_ = lengths[start] > i
        table[open_, i] = codes[start[open_] + i]
    if not len(table):
        return table, np.empty(0, np.int64)
    table = table[np.lexsort(table.T[::-1])]
    first = np.flatnonzero(np.concatenate(([True], (table[1:] != table[:-1]).any(axis=1))))
    return table[first], np.diff(np.append(first, len(table)))


def _read_windows(docs: DataFrame, pairs: np.ndarray, longer: np.ndarray, bits: int, longest: int, borders: list[tuple[str, list[str]]]) -> DataFrame:
    """The windows in sorted runs: one row for each range of a task, with all its windows and their counts.

    ``borders`` are the first windows of the second range and on: at most as many as there are ranges.
    """
    known = docs.sparkSession.sparkContext.broadcast((pairs, longer, [(lang, [w.encode() for w in words]) for lang, words in borders]))

    def rows(held: dict, limits: list) -> Iterator[pa.RecordBatch]:
        every = sorted((lang, key.split(b"\t"), n) for lang, counts in held.items() for key, n in counts.items())
        held.clear()
        start = 0
        for number, limit in enumerate([*limits, None]):
            stop = len(every) if limit is None else bisect.bisect_left(every, limit, start, key=lambda x: x[:2])
            if stop > start:
                yield _run(number, every[start:stop])
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *own, limits = known.value
        held = {}
        for batch in slices(batches, SLICE):
            for lang, numbers, codes in _sequences(batch):
                table, seen = _windows_of(numbers, codes, *own, bits, longest)
                counts, words = held.setdefault(lang, Counter()), numbers.words
                for line, n in zip(table.tolist(), seen.tolist(), strict=True):
                    counts[b"\t".join([words[i] for i in line if i >= 0])] += n
            if sum(map(len, held.values())) > HELD:
                yield from rows(held, limits)
        yield from rows(held, limits)

    return docs.mapInArrow(run, RUNS)


RUNS = "range int, langs array<string>, sizes array<int>, words array<string>, counts array<long>"


def _run(number: int, windows: list[tuple[str, list, int]]) -> pa.RecordBatch:
    """One packed row."""

    def listed(values: list, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

    langs, words, counts = zip(*windows, strict=True)
    flat = [w.decode() if isinstance(w, bytes) else w for own in words for w in own]
    columns = [pa.array([number], pa.int32()), listed(langs, pa.string()), listed([len(own) for own in words], pa.int32()), listed(flat, pa.string()), listed(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["range", "langs", "sizes", "words", "counts"])


def _unpacked_run(row: tuple) -> Iterator[tuple[str, tuple, int]]:
    at = 0
    for lang, size, n in zip(row[1], row[2], row[4], strict=True):
        yield lang, tuple(row[3][at : at + size]), n
        at += size


def _borders(docs: DataFrame, pairs: np.ndarray, longer: np.ndarray, bits: int, longest: int, size: int) -> list[tuple[str, list[str]]]:
    """Windows that cut a sample of about SAMPLE bytes of text into ranges of equal numbers of windows.

    Only how evenly the ranges are filled depends on the sample.
    """
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.where(unit <= min(1.0, SAMPLE / max(size, 1)))
    found = sorted({(lang, words) for row in _read_windows(sample, pairs, longer, bits, longest, []).toLocalIterator() for lang, words, _ in _unpacked_run(row)})
    at = sorted({i * len(found) // ranges for i in range(1, ranges)} - {0})
    return [(found[i][0], list(found[i][1])) for i in at if i < len(found)]


def _shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        n += 1
    return n


def beginnings(runs: DataFrame, least: int) -> DataFrame:
    """``lang, words, n`` of all beginnings of two words or more found ``least`` times, from packed runs of windows.

    Each window counts for all its beginnings. Runs of a range meet in one task, which holds the
    range's different windows.
    """

    def walk(windows: list[tuple[tuple, int]]) -> list[tuple]:
        out, lang, now, sums = [], None, [], []
        # beginnings up to ``edge`` words reach back to the first window of this range
        edge = 0

        def close(depth: int) -> None:
            nonlocal edge
            while len(now) > depth:
                n, size = sums.pop(), len(now)
                if size > 1 and (n >= least or size <= edge):
                    out.append((lang, list(now), n))
                now.pop()
            edge = min(edge, depth)

        for place, ((own, words), n) in enumerate(windows):
            same = _shared(now, words) if own == lang else 0
            close(same)
            lang = own
            now.extend(words[same:])
            sums.extend([0] * (len(words) - same))
            for i in range(len(words)):
                sums[i] += n
            if not place:
                edge = len(words)
        edge = len(now)  # what is open at the end may go on in the next range
        close(0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Counter()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if found := walk(sorted(held.items())):
                        yield _phrases(found)
                    now, held = row[0], Counter()
                for lang, words, n in _unpacked_run(row):
                    held[lang, words] += n
        if found := walk(sorted(held.items())):
            yield _phrases(found)

    placed = runs.repartition("range").sortWithinPartitions("range").select("range", "langs", "sizes", "words", "counts")
    return placed.mapInArrow(run, "lang string, words array<string>, n long").groupBy("lang", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _phrases(rows: list) -> pa.RecordBatch:
    lang, words, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(n, pa.int64())], ["lang", "words", "n"])


def _walked(stream: DataFrame, label: str) -> DataFrame:
    """``lang, words, n, before, longer``: each phrase's beginnings' counts, shortest first, and the most of its phrases of one more word.

    Rows of a phrase whose prolongations lie in another range repeat it there without ``before``.
    """
    keys = ["lang", "words"]
    ranges = stage(stream.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id()), f"{label}-ranges")
    first = ranges.groupBy("range").agg(F.min(F.struct(*keys)).alias("first")).select("range", "first.*")
    open_ = first.select("range", "lang", F.explode(F.expr("transform(sequence(1, greatest(size(words) - 1, 1)), k -> slice(words, 1, k))")).alias("words"), F.size("words").alias("size"))
    open_ = open_.where(F.size("words") < F.col("size")).drop("size")  # a few rows for each range
    borrowed = ranges.drop("range").join(F.broadcast(open_), keys).select("lang", "words", "n", "range", F.lit(True).alias("borrowed"))
    rows = ranges.select("lang", "words", "n", "range", F.lit(False).alias("borrowed")).unionByName(borrowed)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, now, open_rows, out = None, [], [], []

        def close(depth: int) -> None:
            while open_rows and len(open_rows[-1][1]) > depth:
                out.append(open_rows.pop())

        for batch in batches:
            for lang, words, n, range_, lent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = _shared(now, words) if (range_, lang) == place else 0
                close(same)
                place, now = (range_, lang), words
                if open_rows and len(open_rows[-1][1]) == len(words) - 1:
                    open_rows[-1][4] = max(open_rows[-1][4], n)
                open_rows.append([lang, words, n, None if lent else [r[2] for r in open_rows], 0])
            if out:
                yield _walk_rows(out)
                out.clear()
        close(0)
        if out:
            yield _walk_rows(out)

    ordered = rows.repartition("range").sortWithinPartitions("range", *keys).select("lang", "words", "n", "range", "borrowed")
    return ordered.mapInArrow(walk, "lang string, words array<string>, n long, before array<long>, longer long")


def _walk_rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "words", "n", "before", "longer"])


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Staged ``lang, words, n`` of all phrases of 1 to ``longest`` words found ``least`` times, and ``lang, total`` with all words."""
    own = _documents(docs, text, lang)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_A_SLOT).bit_length()))
    counted = stage(_read_counts(own, bits, least), "phrase-words")
    words = stage(counted.where(F.col("kind") == WORD).groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrase-word-sums")
    totals = stage(words.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    pairs = _frequent_slots(counted, bits, least)
    longer = _frequent_slots(_read_longer(own, pairs, bits, least, longest), bits, least)
    borders = _borders(own, pairs, longer, bits, longest, size)
    windows = stage(_read_windows(own, pairs, longer, bits, longest, borders), "phrase-windows")
    single = words.where(F.col("n") >= least).select("lang", F.array("word").alias("words"), "n")
    return stage(beginnings(windows, least).unionByName(single), "phrase-counts"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int | None = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the phrases of 2 to ``longest`` words found at least ``least`` times.

    ``a``: the phrase's count, overlaps included; ``n``: all words of the language.
    A cut gives the counts ``l`` and ``r`` of its two parts and floor(1000 a n / (l r));
    the least of all cuts is the score, at ties the cut after the fewest words. Phrases
    inside a longer one that has ``share`` percent of their count are left out. As a
    phrase counts at least as often as any that holds it, it is enough to look at
    those of one more word. ``top`` is the number of rows for each language (None: all),
    by score, count, phrase (bytes); ranks begin with 1.

    Null and blank texts hold no words; a null language is ``und``. Repeated rows count
    each time, texts are read whole, an empty table gives an empty result.
    """
    stream, totals = phrase_counts(docs, least, longest, text, lang)
    keys = ["lang", "words"]
    forth = _walked(stream, "prefix")
    back = _walked(stream.withColumn("words", F.reverse("words")), "suffix").withColumn("words", F.reverse("words"))
    nothing = F.lit(None).cast("array<long>")
    both = forth.select(*keys, "n", F.col("before").alias("left"), nothing.alias("right"), "longer").unionByName(back.select(*keys, "n", nothing.alias("left"), F.col("before").alias("right"), "longer"))
    met = both.groupBy(*keys).agg(F.max("n").alias("a"), F.max("left").alias("left"), F.max("right").alias("right"), F.max("longer").alias("longer"))
    whole = met.where((F.size("words") > 1) & (F.col("longer") * 100 < F.col("a") * share)).join(small_side(totals), "lang")
    exact = "cast({} as decimal(38,0))"  # products may pass 64 bits; the quotient is at most 1000 n / least
    score = f"(cast(1000 as decimal(38,0)) * a * total) div ({exact.format('left[k - 1]')} * right[size(words) - k - 1])"
    cuts = f"array_min(transform(sequence(1, size(words) - 1), k -> struct({score} as score, k as k, left[k - 1] as l, right[size(words) - k - 1] as r)))"
    found = whole.withColumn("cut", F.expr(cuts)).select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", F.col("total").alias("n"), F.col("cut.score").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)  # each task passes on so many rows of a language at most
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    """DuckDB's form of ``collocations``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with cut as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents where text is not null),
parts as (
  select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') as words from cut),
places as (
  select lang, words, unnest(range(1, len(words) + 1)) as i from parts),
counted as (
  select lang, words[i : i + k - 1] as words, count(*) as f
  from places, range(1, {longest + 1}) as sizes(k) where i + k - 1 <= len(words) group by all),
totals as (select lang, sum(f)::hugeint as n from counted where len(words) = 1 group by lang),
often as materialized (select lang, words, f::hugeint as f from counted where f >= {least}),
longer as (
  select lang, words, max(f) as f from (
    select lang, words[1 : len(words) - 1] as words, f from often where len(words) > 1
    union all select lang, words[2 : len(words)], f from often where len(words) > 1) group by all),
cuts as (
  select o.lang, o.words, o.f as a, t.n, p.f as l, q.f as r, k, (1000::hugeint * o.f * t.n) // (p.f * q.f) as score
  from (select *, unnest(range(1, len(words))) as k from often where len(words) > 1) o
  join totals t on t.lang = o.lang
  join often p on p.lang = o.lang and p.words = o.words[1 : k]
  join often q on q.lang = o.lang and q.words = o.words[k + 1 : len(o.words)]),
best as (
  select lang, words, a, n, arg_min(l, (score, k)) as l, arg_min(r, (score, k)) as r, min(score) as score from cuts group by all),
kept as (
  select b.*, array_to_string(b.words, ' ') as phrase from best b left join longer x on x.lang = b.lang and x.words = b.words
  where x.f is null or x.f < b.a),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked where rank <= {top}"""
