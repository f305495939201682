"""Spelling variants: words one edit apart, found over grams of variable length.

Words stand between two marks. The *gram dictionary* holds all grams of ``LEAST_GRAM`` signs
and prolongs a gram, up to ``LONGEST_GRAM`` signs, as long as more than ``LIST`` words hold
it; grams that are rarer are not prolonged (the pruning), so lists stay short where words
are many. A word is taken apart greedily: from each place the longest gram of the
dictionary, unless the one before reaches as far.

One edit can take away the grams that it touches, those before it that could now go on
past it (their signs up to it begin a longer gram), and those after it that a gram
reaching over it could now cover (the signs from it on end a longer gram). The grams that
are certain to stay, at the worst edit, are the word's bound: near words share that many
grams, at the same place or moved by the edit. So of a word's grams, rarest first, only
so many lists are merged that not all others could be shared without one of them: all
less the bound plus one. Words whose bound is 0 also go into lists by half words, which
finds the pairs in which neither word has a bound: one edit leaves one half whole.

A list is keyed by gram, place and length of the shorter word; pairs of one list are
verified sign by sign, in blocks, as arrays. Long lists are cut into blocks that are
dealt to tasks in pairs; nothing is emitted but verified pairs.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.common import slices
from postlens.runtime import stage

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_GRAM, LONGEST_GRAM = 2, 4
# Words that a gram may have before longer ones take its place, and grams in the dictionary beside the shortest.
LIST, GRAMS = 2_000, 1 << 17
# Different words or grams that a task adds up before it passes them on, and words of a list that are compared at once.
HELD, BLOCK = 300_000, 1_024
FIRST, LAST = "\x02", "\x03"


def runs(text: str) -> list[str]:
    """The maximal runs of letters, A-Z in lower case."""
    return RUNS.findall(text.encode().lower().decode())


def altered(run: str, mark: int, every: int) -> str:
    """``run`` without one of its code points if ``every`` divides the crc32 that began with ``mark``."""
    h = zlib.crc32(run.encode(), mark)
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, least_length: int = 6, every: int = 199, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` over all texts. ``every`` (0: never) sets which runs of a document lose a code point."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(held: Counter) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
        held.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in slices(batches):
            for one, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mark = zlib.crc32(f"{one}:".encode() if one is not None else b":")
                for own, n in Counter(runs(found)).items():
                    if len(own) >= least_length:
                        word = altered(own, mark, every)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) > HELD:
                    yield out(held)
        if held:
            yield out(held)

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """The dictionary: numbers of its grams by rarity, and what begins and ends its longer ones."""

    def __init__(self, counts: dict[str, int]):
        self.order = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)), 1)}
        self.longest = max(map(len, counts), default=LEAST_GRAM)
        self.beginnings = {g[:k] for g in counts for k in range(1, len(g))}
        self.endings = {g[k:] for g in counts for k in range(1, len(g))}

    def parts(self, marked: str) -> list[tuple[int, int]]:
        """The places of the grams into which a word between its marks falls."""
        found, reached, order = [], 0, self.order
        for at in range(len(marked) - LEAST_GRAM + 1):
            end = at + LEAST_GRAM
            for stop in range(min(len(marked), at + self.longest), end, -1):
                if marked[at:stop] in order:
                    end = stop
                    break
            if end > reached:
                found.append((at, end))
                reached = end
        return found

    def bound(self, marked: str, parts: list[tuple[int, int]]) -> int:
        """How many of the parts stay at least, whatever one edit between the marks is made."""
        size, reach = len(marked), self.longest
        before, after = [], []
        for i in range(size + 1):
            # grams up to place i stay if nothing from their start on could grow over it
            open_ = next((p for p in range(max(0, i - reach + 1), i) if marked[p:i] in self.beginnings), size)
            before.append(sum(e <= i and p < open_ for p, e in parts))
            # grams from place i on stay if nothing that ends a gram from there covers them
            cover = next((x for x in range(min(size, i + reach - 1), i, -1) if marked[i:x] in self.endings), -1)
            after.append(sum(p >= i and e > cover for p, e in parts))
        # an insertion before i leaves the signs from i on, a deletion or a change at i those from i + 1
        return min(before[i] + min(after[i], after[i + 1] if i < size - 1 else after[i]) for i in range(1, size))

    def lists(self, word: str) -> tuple[int, list[tuple[str, int]]]:
        """The word's bound, and the grams and their places whose lists it has to be in."""
        marked = FIRST + word + LAST
        parts = self.parts(marked)
        bound = self.bound(marked, parts)
        ranked = sorted((self.order.get(marked[p:e], 0), marked[p:e], p) for p, e in parts)
        return bound, [(gram, at) for _, gram, at in ranked[: len(ranked) - max(bound, 1) + 1]]


def _lists(grams: Grams, word: str) -> Iterator[tuple[str, int, int, bool]]:
    """Key (gram, place, length of the shorter word) of each list that holds ``word``; whether it is there as the longer one.

    Half words have places below 0.
    """
    size = len(word)
    bound, merged = grams.lists(word)
    for gram, at in merged:
        yield gram, at, size, False
        yield gram, at, size - 1, True  # the edit lies behind the gram
        if at:
            yield gram, at - 1, size - 1, True  # or before it
    if bound < 1:
        for short, longer in ((size, False), (size - 1, True)):
            half = short // 2
            yield word[:half], -1, short, longer
            yield word[size - (short - half) :], -2, short, longer


def gram_dictionary(words: DataFrame, limit: int = LIST, most: int = GRAMS) -> dict[str, int]:
    """The grams of the dictionary with their counts over all ``words``; at most ``most`` beside those of the least length.

    With more, the limit rises until they fit. The shortest grams are bounded by the square of the alphabet.
    """
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])

    def out(held: Counter) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
        held.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                marked = FIRST + word + LAST
                held.update(marked[p : p + q] for q in range(LEAST_GRAM, LONGEST_GRAM + 1) for p in range(len(marked) - q + 1))
                if len(held) > HELD:
                    yield out(held)
        if held:
            yield out(held)

    counts = stage(words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    shortest = {r["gram"]: r["n"] for r in counts.where(F.length("gram") == LEAST_GRAM).collect()}
    longer = counts.where(F.length("gram") > LEAST_GRAM).withColumn("shorter", F.expr("substring(gram, 1, length(gram) - 1)"))
    often = counts.where(F.col("n") > limit).select(F.col("gram").alias("shorter"), F.col("n").alias("above"))
    rows = longer.join(often, "shorter").orderBy(F.desc("above"), "gram").limit(most + 1).collect()
    if len(rows) > most:
        rows = [r for r in rows if r["above"] > rows[-1]["above"]]
    return shortest | {r["gram"]: r["n"] for r in rows}


def _matrix(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of a matrix."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def changed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` differ in exactly one place."""
    differ = np.zeros((len(a), len(b)), np.uint8)
    for i in range(a.shape[1]):
        differ += a[:, i, None] != b[None, :, i]
    return differ == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b``, one longer, are those of ``a`` with one sign put in."""
    size = a.shape[1]
    ahead, back = np.zeros((len(a), len(b)), np.uint8), np.zeros((len(a), len(b)), np.uint8)
    same = np.ones((len(a), len(b)), bool)
    for i in range(size):
        same &= a[:, i, None] == b[None, :, i]
        ahead += same
    same[:] = True
    for i in range(size):
        same &= a[:, size - 1 - i, None] == b[None, :, size - i]
        back += same
    return ahead.astype(np.int16) + back >= size


_LISTED = pa.schema([("list", pa.string()), ("longer", pa.bool_()), ("block", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
_PAIRS = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])
LISTED = "list string, longer boolean, block int, word string, n long"


def near_pairs(words: DataFrame, limit: int = LIST, most: int = GRAMS, block: int = BLOCK) -> DataFrame:
    """``a, a_n, b, b_n``, each pair once, of staged ``word, n``: words exactly one edit apart.

    Words are distinct, not null, and of signs below U+0100.
    """
    spark = words.sparkSession
    dictionary = spark.sparkContext.broadcast(gram_dictionary(words, limit, most))  # bounded by ``most``

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(dictionary.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part, rows = batch.slice(start, 2_000), []
                for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True):
                    block_ = zlib.crc32(word.encode()) & 0x7FFFFFFF
                    rows += [(f"{gram}\x1f{at}\x1f{size}", longer, block_, word, n) for gram, at, size, longer in set(_lists(grams, word))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LISTED, strict=True)], schema=_LISTED)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a list, or of a pair of its blocks, come one after the other
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held = []
        for (_, one, two), group in itertools.groupby(rows, key=lambda r: r[:3]):
            held += _compared(one == two, one, [r[3:] for r in group], block)
            if len(held) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _PAIRS, strict=True)], schema=_PAIRS)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _PAIRS, strict=True)], schema=_PAIRS)

    listed = stage(words.select("word", "n").mapInArrow(deal, LISTED), "word-lists")
    # lists with a pair to compare, and the number of blocks of the long ones
    sizes = listed.groupBy("list").agg(F.count("*").alias("size"), F.count_if(~F.col("longer")).alias("own"))
    sizes = stage(sizes.where("own > 0 and size > 1").select("list", F.ceil(F.col("size") / (4 * block)).cast("int").alias("blocks")), "word-list-sizes")
    met = listed.join(sizes, "list").withColumn("block", F.col("block") % F.col("blocks"))
    # a row meets each block of its list once: the smaller block number first
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = met.select("list", "longer", "block", "word", "n", other).select(
        "list", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "longer", "word", "n"
    )
    found = pairs.repartition("list", "one", "two").sortWithinPartitions("list", "one", "two").mapInArrow(compare, "a string, a_n long, b string, b_n long")
    return found.distinct()


def _compared(within: bool, one: int, rows: list[tuple], block: int) -> Iterator[tuple[str, int, str, int]]:
    """Verified pairs of ``block, longer, word, n`` rows: all pairs, or those between two blocks."""
    if len(rows) < 2:
        return
    own = [r for r in rows if not r[1]]
    more = [r for r in rows if r[1]]
    for left, right, near in ((own, own, changed), (own, more, inserted)):
        same = left is right
        for start in range(0, len(left), block):
            a = left[start : start + block]
            first = _matrix([r[2].encode("latin-1") for r in a])
            for at in range(start if same else 0, len(right), block):
                b = right[at : at + block]
                x, y = np.nonzero(near(first, _matrix([r[2].encode("latin-1") for r in b])))
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    (p, _, v, n), (q, _, w, m) = a[i], b[j]
                    if (within or p != q) and (not same or v < w or at > start):
                        yield (v, n, w, m) if v < w else (w, m, v, n)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of staged ``word, form``: forms followed to the last, in steps that double.

    Each form's count is a multiple of its word's, so chains are short and have no circles.
    """
    now = stage(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(
    docs: DataFrame, least_length: int = 6, least: int = 5, times: int = 5, every: int = 199, doc_id: str = "doc_id", text: str = "text", limit: int = LIST, most: int = GRAMS, block: int = BLOCK
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of all texts.

    Words: see ``word_counts``, of at least ``least_length`` code points and ``least``
    occurrences. ``n_near`` words differ by one inserted, deleted or replaced code point;
    the one of the largest n (ties: the smallest) is the ``form`` if that n is at least
    ``times`` the word's, else null. ``root`` is the last of the forms, the word itself
    if it has none.

    Null and empty texts hold no words; a null id stands as the empty text in the checksum
    that alters runs. Repeated rows count each time, texts are read whole, an empty table
    gives an empty result.
    """
    words = stage(word_counts(docs, least_length, every, doc_id, text).where(F.col("n") >= least), "variant-words")
    pairs = stage(near_pairs(words, limit, most, block), "variant-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("form"))).alias("best"))
    fits = -F.col("best.n") >= F.col("n") * times
    found = words.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.n")).cast("long").alias("form_n")
    )
    found = stage(found, "variants")
    return found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")
