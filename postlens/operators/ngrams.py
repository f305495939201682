"""Phrase counts."""

from __future__ import annotations

import heapq
import sys
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window
from pyspark.sql.pandas.types import to_arrow_schema

from postlens import runtime
from postlens.functions import text

# Functions of this module go to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The three phrase lengths.
NGRAM_TYPES = {"unigram": 1, "bigram": 2, "trigram": 3}
# Slots for the hashes of phrases that repeat: as many bits (16 MB) go to the tasks, whatever the corpus.
SLOTS = 1 << 27
# Phrases that a task keeps in a summary.
SUMMARY = 20_000
# Phrases that begin in one run of terms, terms and rows that a task counts together, their bytes, rows of a batch that it passes on.
RUN, HELD, HELD_BYTES, PASSED_ON = 256, 2_000_000, 1 << 27, 50_000
# Buckets of phrases, how many are packed at once, and the phrases at least that are added up at once. A factor that mixes bits.
BUCKETS, BUCKETS_AT_ONCE, ADDED, MIX = 4096, 256, 500_000, np.uint64(0x9E3779B97F4A7C15)


def phrases(df: DataFrame, field: str, keep: list[str | Column], sizes: dict[str, int] | None = None) -> DataFrame:
    """One row per phrase occurrence of ``field``: the kept columns, ``ngram_type``, ``phrase``.

    The terms are cut out once per row and shared by all lengths.
    """
    sizes = NGRAM_TYPES if sizes is None else sizes
    tokens = df.select(*keep, text.terms(F.col(field)).alias("_terms"))
    names = tokens.columns[:-1]
    pairs = []
    for name, n in sizes.items():
        pairs += [F.lit(name), text.ngrams(F.col("_terms"), n)]
    by_size = tokens.select(*names, F.stack(F.lit(len(sizes)), *pairs).alias("ngram_type", "_grams"))
    return by_size.select(*names, "ngram_type", F.explode("_grams").alias("phrase"))


def term_runs(df: DataFrame, field: str, keep: list[str], longest: int) -> DataFrame:
    """The kept columns and ``terms``: runs in which RUN phrases begin at most, with the terms that the last of them need.

    So no row is longer than that, whatever its text, and every phrase of up to ``longest`` terms begins in one run.
    """

    def runs(terms: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(terms) - F.lit(1), F.lit(0)), F.lit(RUN))
        return F.transform(starts, lambda at: F.slice(terms, at + F.lit(1), F.lit(RUN + longest - 1)))

    # as an element of an array the terms have a name: else they would be cut out for every use
    own = F.flatten(F.transform(F.array(text.terms(F.col(field))), runs))
    return df.select(*keep, F.explode(own).alias("terms")).where(F.size("terms") > 0)


class Tally:
    """Occurrences of phrases in some runs of terms, as numbers: a term has its place in ``words``, a row's keys theirs in ``keys``."""

    def __init__(self, batches: list[pa.RecordBatch], keys: list[str]):
        table = pa.Table.from_batches(batches)
        lists = table.column("terms").combine_chunks()
        encoded = lists.flatten().dictionary_encode()
        self.words = encoded.dictionary
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        known: dict[tuple, int] = {}
        if keys:
            group = np.array([known.setdefault(k, len(known)) for k in zip(*(table.column(k).to_pylist() for k in keys), strict=True)], np.int64)
        else:
            known[()], group = 0, np.zeros(len(size), np.int64)
        self.keys = [pa.array([g[i] for g in known], table.schema.field(k).type) for i, k in enumerate(keys)]
        self.width = len(known)
        self.key_hashes = np.array([zlib.crc32(repr(k).encode()) for k in known], np.uint64)
        self.word_hashes = np.array([zlib.crc32(w.as_buffer()) for w in self.words], np.uint64)
        self.group = np.repeat(group, size)
        self.place = np.arange(len(self.codes)) - np.repeat(np.cumsum(size) - size, size)
        self.left = np.repeat(size, size) - self.place

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero((self.left >= n) & (self.place < RUN))

    def count(self, n: int, at: np.ndarray, limit: int = 1 << 62) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Group, terms and count of each different phrase of ``n`` terms that starts ``at`` one of these places.

        A phrase is one number. Should numbers pass ``limit``, they are replaced by their ranks in between.
        """
        number, bound, ranks = self.group[at], self.width, []
        for i in range(n):
            ranked = None
            if bound * len(self.words) > limit:
                ranked, number = np.unique(number, return_inverse=True)
                bound = len(ranked)
            ranks.append(ranked)
            number = number * len(self.words) + self.codes[at + i]
            bound *= len(self.words)
        number.sort()
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(number)))
        number, terms = number[first], []
        for ranked in reversed(ranks):
            number, term = np.divmod(number, len(self.words))
            terms.append(term)
            number = number if ranked is None else ranked[number]
        return number, terms[::-1], counts

    def hashes(self, group: np.ndarray, terms: list[np.ndarray]) -> np.ndarray:
        """A hash of each phrase and its keys, the same in every task."""
        mixed = self.key_hashes[group]
        for term in terms:
            mixed = (mixed ^ self.word_hashes[term]) * MIX
            mixed ^= mixed >> np.uint64(31)
        return mixed

    def slots(self, at: np.ndarray, n: int, slots: int) -> np.ndarray:
        """The slots of the phrases of ``n`` terms that start ``at`` these places."""
        return (self.hashes(self.group[at], [self.codes[at + i] for i in range(n)]) % np.uint64(slots)).astype(np.int64)

    def phrases(self, terms: list[np.ndarray]) -> pa.Array:
        parts = [self.words.take(pa.array(t)) for t in terms]
        return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")


    def holding(self, terms: list[np.ndarray], counts: np.ndarray, containing: str, at_once: int = 1 << 20) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """The counted phrases that hold ``containing``, and their counts, ``at_once`` at most."""
        for at in range(0, len(counts), at_once):
            part = slice(at, at + at_once)
            found, own = self.phrases([t[part] for t in terms]), counts[part]
            if containing:
                holds = pc.match_substring(found, containing)
                found, own = found.filter(holds), own[holds.to_numpy(zero_copy_only=False)]
            yield found, own


def _tallies(batches: Iterator[pa.RecordBatch], keys: list[str], held: int) -> Iterator[Tally]:
    """All runs of a task, ``held`` terms and rows or more at a time: its memory does not grow with the task."""
    own, size, space = [], 0, 0
    for batch in batches:
        own.append(batch)
        size += len(batch) + len(batch.column("terms").flatten())
        space += batch.nbytes
        if size >= held or space >= HELD_BYTES:
            yield Tally(own, keys)
            own, size, space = [], 0, 0
    if size:
        yield Tally(own, keys)


def packed_counts(
    runs: DataFrame, keys: list[str], sizes: dict[str, int], inside: pa.Schema, held: int, passing: Callable[[Tally, int], np.ndarray]
) -> DataFrame:
    """``ngram_type, bucket, packed``: what a task has counted of the phrases of a bucket, a hash of phrase and keys, as one Arrow batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tally in _tallies(batches, keys, held):
            for name, n in sizes.items():
                group, terms, counts = tally.count(n, passing(tally, n))
                bucket = (tally.hashes(group, terms) % np.uint64(BUCKETS)).astype(np.uint16)
                order = np.argsort(bucket, kind="stable")
                found, first = np.unique(bucket[order], return_index=True)
                ends = np.append(first[1:], len(order))
                for at in range(0, len(found), BUCKETS_AT_ONCE):
                    part = slice(at, at + BUCKETS_AT_ONCE)
                    start, rows = first[at], order[first[at] : ends[part][-1]]
                    columns = [*(k.take(pa.array(group[rows])) for k in tally.keys), tally.phrases([t[rows] for t in terms]), pa.array(counts[rows])]
                    whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, inside, strict=True)], schema=inside)
                    packed = [whole.slice(i - start, j - i).serialize().to_pybytes() for i, j in zip(first[part], ends[part], strict=True)]
                    own = [pa.array([name] * len(packed)), pa.array(found[part].astype(np.int32)), pa.array(packed, pa.binary())]
                    yield pa.RecordBatch.from_arrays(own, ["ngram_type", "bucket", "packed"])

    return runs.select(*keys, "terms").mapInArrow(work, "ngram_type string, bucket int, packed binary")


def phrase_counts(
    runs: DataFrame,
    keys: list[str],
    sizes: dict[str, int],
    min_count: int = 1,
    held: int | None = None,
    passing: Callable[[Tally, int], np.ndarray] | None = None,
) -> DataFrame:
    """``keys, ngram_type, phrase, count`` of runs of terms: how often each phrase occurs, if at least ``min_count`` times.

    Tasks count their own runs first, as numbers. What they have counted is shuffled by buckets, a row for each, and added up
    bucket by bucket. ``passing`` tells where phrases start that count.
    """
    fields = [runs.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("ngram_type", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("count", T.LongType())])
    inside = to_arrow_schema(T.StructType([*fields, schema["phrase"], schema["count"]]))
    packed = packed_counts(runs, keys, sizes, inside, HELD if held is None else held, passing or Tally.starts)

    def added(parts: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table.group_by([*keys, "phrase"], use_threads=False).aggregate([("count", "sum")]).rename_columns({"count_sum": "count"})

    def result(name: str, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = added(parts)
        table = table.filter(pc.greater_equal(table.column("count"), min_count))
        for batch in table.combine_chunks().to_batches(max_chunksize=PASSED_ON):
            columns = [*(batch.column(k) for k in keys), pa.array([name] * len(batch), pa.string()), batch.column("phrase"), batch.column("count")]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, last = [], 0, None
        for batch in batches:
            for name, bucket, packed_ in zip(*(batch.column(c) for c in ("ngram_type", "bucket", "packed")), strict=True):
                at = name.as_py(), bucket.as_py()
                if parts and (at[0] != last[0] or (at != last and size >= ADDED)):
                    yield from result(last[0], parts)
                    parts, size = [], 0
                elif size >= 4 * ADDED:  # one bucket alone: only its different phrases are kept
                    parts = added(parts).select(inside.names).combine_chunks().cast(inside).to_batches()
                    size = 0
                parts.append(pa.ipc.read_record_batch(packed_.as_buffer(), inside))
                size += len(parts[-1])
                last = at
        if parts:
            yield from result(last[0], parts)

    dealt = packed.repartition("ngram_type", "bucket").sortWithinPartitions("ngram_type", "bucket")
    return dealt.mapInArrow(merge, schema)


def ngram_counts(df: DataFrame, field: str, n: int | tuple[int, ...] = 1, min_count: int = 2) -> DataFrame:
    """Total frequency of each n-gram that occurs at least ``min_count`` times; of several lengths in one reading, with a column ``n``."""
    if isinstance(n, int):
        return phrase_counts(term_runs(df, field, [], n), [], {"n": n}, min_count).select("phrase", "count")
    counts = phrase_counts(term_runs(df, field, [], max(n)), [], {str(size): size for size in n}, min_count)
    return counts.select("phrase", "count", F.col("ngram_type").cast("int").alias("n"))


def sort_counts(counts: DataFrame) -> DataFrame:
    """Most frequent first; equal counts by phrase."""
    return counts.orderBy(F.desc("count"), "phrase")


def top_words(
    df: DataFrame,
    field: str,
    n: int = 1,
    top: int = 20,
    containing: str = "",
    exclusions: DataFrame | None = None,
) -> DataFrame:
    """The ``top`` most frequent n-grams, without exact exclusions, holding ``containing``."""
    return _top(ngram_counts(df, field, n, min_count=1), top, containing, exclusions)


def _top(counts: DataFrame, top: int, containing: str, exclusions: DataFrame | None) -> DataFrame:
    if exclusions is not None:
        counts = counts.join(exclusions.select("phrase"), "phrase", "left_anti")
    if containing:
        counts = counts.filter(F.col("phrase").contains(containing))
    return sort_counts(counts).limit(top)


def top_words_by_summaries(
    df: DataFrame,
    field: str,
    n: int = 1,
    top: int = 20,
    containing: str = "",
    exclusions: DataFrame | None = None,
    kept: int = SUMMARY,
) -> DataFrame:
    """The rows of ``top_words`` without shuffling all phrases. The terms are cut out once and staged.

    Each task keeps at most ``kept`` phrases with counts (Misra and Gries): when there are more,
    all lose the same amount, and what has been lost is the task's error. Added up
    over the tasks, a phrase's counts are at most all errors too low. So if the
    ``top``-th largest is above the errors, only phrases that could reach it have to be
    counted, exactly, in a second reading that passes nothing else on. Otherwise,
    as when hardly any phrase stands out, all are counted.
    """
    runs = runtime.stage(term_runs(df, field, [], n), "term-runs")
    if exclusions is not None:
        # excluded phrases may be many: they are tested where there are few candidates
        excluded = exclusions.select("phrase").distinct()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lost = Counter(), 0
        for tally in _tallies(batches, [], HELD):
            _, terms, own = tally.count(n, tally.starts(n))
            for found, number in tally.holding(terms, own, containing):
                # of these phrases only the most frequent can be among those kept: the others go at once
                cut = int(np.partition(number, -kept - 1)[-kept - 1]) if len(number) > kept else 0
                counts.update(dict(zip(found.filter(pa.array(number > cut)).to_pylist(), (number[number > cut] - cut).tolist(), strict=True)))
                lost += cut
                if len(counts) > kept:
                    cut = heapq.nlargest(kept + 1, counts.values())[-1]
                    lost += cut
                    counts = Counter({p: c - cut for p, c in counts.items() if c > cut})
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), lost], pa.int64())], ["phrase", "count"])

    def counted_by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tally in _tallies(batches, [], HELD):
            _, terms, own = tally.count(n, tally.starts(n))
            for found, number in tally.holding(terms, own, containing, PASSED_ON):
                yield pa.RecordBatch.from_arrays([found, pa.array(number)], ["phrase", "count"])

    def all_counted() -> DataFrame:
        return _top(phrase_counts(runs, [], {"n": n}).select("phrase", "count"), top, containing, exclusions)

    found = runtime.stage(runs.mapInArrow(summarise, "phrase string, count long").groupBy("phrase").agg(F.sum("count").alias("count")), "summaries")
    error = found.filter("phrase is null").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    found = found.filter("phrase is not null")
    if exclusions is not None:
        found = found.join(excluded, "phrase", "left_anti")
    best = sort_counts(found).limit(top).collect()
    least = best[-1]["count"] if len(best) == top else 0
    if error >= least > 0 or (least == 0 and error):
        return all_counted()
    candidates = runtime.stage(found.filter(F.col("count") + error >= least).select("phrase"), "candidates")
    if not runtime.fits_broadcast(candidates):
        return all_counted()
    rows = runs.mapInArrow(counted_by_task, "phrase string, count long")
    counted = rows.join(F.broadcast(candidates), "phrase", "left_semi").groupBy("phrase").agg(F.sum("count").alias("count"))
    return sort_counts(counted).limit(top)


def top_words_by(df: DataFrame, field: str, by: str, n: int = 1, top: int = 20) -> DataFrame:
    """``top_words`` for every value of ``by``."""
    counts = phrase_counts(term_runs(df, field, [by], n), [by], {"n": n}).drop("ngram_type")
    order = Window.partitionBy(by).orderBy(F.desc("count"), "phrase")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def without_year(posts: DataFrame, excluded_year: int | None) -> DataFrame:
    """Rows of other years; rows without a month go as well."""
    rows = posts.filter(F.col("month").isNotNull())
    return rows if excluded_year is None else rows.filter(F.year("month") != excluded_year)


def distinct_months(posts: DataFrame, excluded_year: int | None = None) -> DataFrame:
    months = posts.select("month")
    if excluded_year is not None:
        months = without_year(months, excluded_year)
    return months.distinct()


def in_months(rows: DataFrame, months: DataFrame) -> DataFrame:
    """The rows of the given months; the list of months is as short as the calendar."""
    return rows.join(F.broadcast(months), "month", "left_semi")


def monthly_ngrams(
    posts: DataFrame,
    hashtags: DataFrame,
    mentions: DataFrame,
    excluded_year: int | None = 2022,
    min_count: int = 2,
) -> DataFrame:
    """Phrase counts per month for three phrase lengths of three fields, in one aggregation.

    Only months in which there are posts count, also for hashtags and mentions.
    """
    rows = _fields(posts, hashtags, mentions, excluded_year)
    runs = term_runs(rows, "text", ["category", "month"], max(NGRAM_TYPES.values()))
    return phrase_counts(runs, ["category", "month"], NGRAM_TYPES, min_count).select("category", "ngram_type", "month", "phrase", "count")


def _fields(posts: DataFrame, hashtags: DataFrame, mentions: DataFrame, excluded_year: int | None) -> DataFrame:
    """``category, month, text`` of the three fields; only months in which there are posts."""
    months = distinct_months(posts, excluded_year)

    def field(df: DataFrame, name: str, category: str) -> DataFrame:
        return in_months(df.select("month", F.col(name).alias("text")), months).withColumn("category", F.lit(category))

    # posts' own months need no look-up
    own = without_year(posts.select("month", F.col("content").alias("text")), excluded_year).withColumn("category", F.lit("tweet"))
    return own.unionByName(field(hashtags, "hashtags", "hashtag")).unionByName(field(mentions, "username", "mention"))


def monthly_ngrams_by_levels(
    posts: DataFrame,
    hashtags: DataFrame,
    mentions: DataFrame,
    excluded_year: int | None = 2022,
    min_count: int = 2,
    slots: int = SLOTS,
) -> DataFrame:
    """The rows of ``monthly_ngrams``, staged, for corpora whose longer phrases seldom repeat.

    A phrase can only repeat in a month and field if both phrases of one word less
    in it do. So lengths are counted one after the other, and only phrases whose two parts
    passed are shuffled. What passed goes to them as slots of hashes, a bit each;
    phrases that share a slot with one that repeats are counted for nothing, and
    none is lost. The terms are cut out once and staged.
    """
    keys = ["category", "month"]
    runs = term_runs(_fields(posts, hashtags, mentions, excluded_year), "text", keys, max(NGRAM_TYPES.values()))
    runs = runtime.stage(runs, "month-terms")
    found, bits = [], None
    for name, n in sorted(NGRAM_TYPES.items(), key=lambda item: item[1]):
        counts = phrase_counts(runs, keys, {name: n}, min_count, passing=Tally.starts if bits is None else _both_parts(bits, slots))
        counts = runtime.stage(counts, f"month-{name}s")
        found.append(counts.select("category", "ngram_type", "month", "phrase", "count"))
        bits = _bits(counts, keys, n, slots) if n < max(NGRAM_TYPES.values()) else None
    return found[0].unionByName(found[1]).unionByName(found[2])


def _bits(counts: DataFrame, keys: list[str], n: int, slots: int) -> np.ndarray:
    """A bit for each slot, set where a counted phrase of ``n`` terms has its hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pc.split_pattern(batch.column("phrase"), " ")], [*keys, "terms"])
            tally = Tally([split], keys)
            own = np.unique(tally.slots(np.flatnonzero(tally.place == 0), n, slots))
            yield pa.RecordBatch.from_arrays([pa.array(own // 64), pa.array(own % 64)], ["word", "bit"])

    slot = counts.select(*keys, "phrase").mapInArrow(work, "word long, bit long")
    # at most a row for 64 slots
    words = slot.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("bits")).toArrow()
    bits = np.zeros(slots // 64 + 1, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits


def _both_parts(bits: np.ndarray, slots: int) -> Callable[[Tally, int], np.ndarray]:
    """Where phrases start whose two parts, of a term less, both have their slot's bit."""

    def passing(tally: Tally, n: int) -> np.ndarray:
        part = np.flatnonzero(tally.left >= n - 1)
        slot = tally.slots(part, n - 1, slots)
        passed = np.zeros(len(tally.left) + 1, bool)
        passed[part] = (bits[slot >> 6] >> (slot & 63)) & 1
        at = tally.starts(n)
        return at[passed[at] & passed[at + 1]]

    return passing


def _slot(category: Column, month: Column, phrase: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(category, month, phrase), F.lit(slots))


def _passing(rows: DataFrame, n: int, passed: DataFrame | None, slots: int) -> DataFrame:
    """``category, month, phrase`` of all phrases of ``n`` terms; with ``passed`` of those whose two parts are in its slots."""
    grams = text.ngrams(F.col("terms"), n)
    if passed is None:
        return rows.select("category", "month", F.explode(grams).alias("phrase"))
    parts = F.transform(text.ngrams(F.col("terms"), n - 1), lambda part: _slot(F.col("category"), F.col("month"), part, slots))
    zipped = F.arrays_zip(grams.alias("phrase"), parts.alias("first"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("second"))
    one = rows.select("category", "month", F.explode(zipped).alias("gram")).select("category", "month", "gram.phrase", "gram.first", "gram.second").where("phrase is not null")
    for part in ("first", "second"):  # at most ``slots`` numbers
        one = one.join(F.broadcast(passed.withColumnRenamed("slot", part)), part, "left_semi")
    return one.select("category", "month", "phrase")


def collated_ngrams(monthly: DataFrame) -> DataFrame:
    """The report form: ``Tweet``, ``Unigrams``, ..."""
    return monthly.select(
        "phrase",
        "count",
        "month",
        F.initcap("category").alias("category"),
        F.concat(F.initcap("ngram_type"), F.lit("s")).alias("ngram_type"),
    )
