"""Exact k-nearest-neighbour search and votes over sparse text weights.

The squared distance of a query q and a training row t is

    blocks(q) + blocks(t) - 2 * dot(q, t) + (difference of both scores)^2

because every filled text block has length 1. Only pairs that share a term have
a dot product, and it can only bring them closer. So the k nearest rows are
among

  - the pairs that share a term, found by joining the weights on the term, and
  - the k rows that come first when all dot products are taken as 0.

The second part depends on nothing but the two scores of q. Scores have two
decimals, so there are at most 201 x 101 different pairs of them, on either
side, however many posts there are.

A small training sample is searched as an index (see ``postings``) that the driver builds and sends
to the queries: nothing is joined, and lists of frequent terms mostly stay unread. Only
when that would take more than ``SEARCHES`` broadcasts the weights are joined on the term.

From ``TEXT_BYTES`` of training texts on, nothing but counts goes through the driver. Tasks put
training rows and queries into packs of rows that are alike in mentions and hashtags, the packs' terms get their
frequencies in a join, and every pack of queries meets every pack of its run's training rows. A
task keeps the nearest so far, and reads the contents only of rows that may be nearer. No
pair is shuffled, only the nearest of each task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, Window

from postlens import runtime
from postlens.functions import scalars
from postlens.operators import features, postings

# Functions of this module go to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCORES = ("sentiment", "subjectivity")
# Pairs of a query and a training row one task should see, roughly, and the bytes of
# query rows below which a task is not made smaller.
PAIRS_PER_TASK, QUERY_BYTES_PER_TASK = 10_000_000, 8 * 1024 * 1024
# Distances of score pairs and training cells that a task works out at most, roughly.
CELLS_PER_TASK = 200_000_000
# Broadcasts of indexes, one after the other, beyond which the weights are joined instead.
SEARCHES = 16
# Training texts up to so many bytes, all runs together, become indexes on the driver.
TEXT_BYTES = 16 * 1024 * 1024
# Rows and terms, repeats included, of a pack, about; packs of a file, and packs that a task makes.
PACK_ROWS, QUERY_PACK_ROWS, PACK_TERMS, PACKS_PER_FILE, PACKS_PER_TASK = 8_000, 1_000, 500_000, 4, 8
# Packs of queries that a task has, of training rows that it has at most, and of these that it takes the nearest of first.
ASKED_PER_TASK, GIVEN_PER_TASK, MET_AT_ONCE = 8, 256, 8
# Rows that are alike in their short blocks and stay together, at most, about.
CLUSTER_ROWS = 2_000
# Spark's setting that a join's sides have to be partitioned by all its keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def neighbours(
    train: DataFrame,
    query: DataFrame,
    k: int,
    broadcast_limit: int | None = None,
) -> DataFrame:
    """The ``k`` nearest training rows of every query row: run, id, rank, train_id, category, distance2.

    ``train`` (run, id, the three text fields, both scores, category) is a sample;
    ``query`` has the same columns without the category. Both are read several
    times and should be staged. A query row only meets the training rows of its run. Scores
    are rounded to two places first. Distances are compared after rounding to nine places,
    and equal ones by training id. Both may have bags of one call of ``features.bagged`` instead of texts.
    """
    train, query = (_rounded(features.as_single_run(rows)) for rows in (train, query))
    sizes = {row["run"]: row["count"] for row in train.groupBy("run").count().collect()}
    for run, count in sizes.items():
        if count < k:
            raise ValueError(f"run {run}: {k} neighbours asked of {count} training rows")

    if "bag" in train.columns:
        return _dealt(train, query, sizes, k)
    if runtime.byte_size(train.select(*features.BLOCKS)) > TEXT_BYTES:
        return _dealt(*features.bagged(train, query), sizes, k)

    model = features.fit(train)
    train_weights = runtime.stage(model.transform(train, broadcast_limit=broadcast_limit, numbered=True), "train-weights")
    parallel = query.sparkSession.sparkContext.defaultParallelism
    queries = {row["run"]: row["count"] for row in query.groupBy("run").count().collect()}
    pairs = sum(count * sizes.get(run, 0) for run, count in queries.items())
    partitions = -(-pairs // PAIRS_PER_TASK)
    if partitions > parallel:
        partitions = min(partitions, -(-runtime.byte_size(query) // QUERY_BYTES_PER_TASK))
    partitions = max(parallel, partitions)

    limit = runtime.BROADCAST_BYTES if broadcast_limit is None else broadcast_limit
    entries = {row["run"]: row["count"] for row in train_weights.groupBy("run").count().collect()}
    known = {run: entries.get(run, 0) * postings.ENTRY_BYTES + count * postings.ROW_BYTES for run, count in sizes.items()}
    if sum(known.values()) <= SEARCHES * limit:
        return _searched(train, train_weights, query, model, known, k, partitions, limit)
    return _joined(train, train_weights, query, model, k, partitions, broadcast_limit)


def _bags(weights: DataFrame, rows: DataFrame, carry: list[str]) -> DataFrame:
    """One row per post, also without known terms: ``run, id``, ``carry``, ``blocks, terms, weights, kinds``."""
    kind = F.array_position(F.array(*[F.lit(b) for b in features.BLOCKS]), F.col("block")) - 1
    term = F.struct("term", "weight", kind.cast("int").alias("kind"))
    filled = weights.select("run", "id", *carry, "blocks", term.alias("entry"))
    bare = rows.select("run", "id", *carry, F.lit(0).alias("blocks"), F.lit(None).cast(filled.schema["entry"].dataType).alias("entry"))
    entries = F.array_sort(F.collect_list("entry"))
    grouped = filled.unionByName(bare).groupBy("run", "id", *carry).agg(F.max("blocks").alias("blocks"), entries.alias("entries"))
    fields = {"terms": "term", "weights": "weight", "kinds": "kind"}
    return grouped.select("run", "id", *carry, "blocks", *[F.col(f"entries.{field}").alias(name) for name, field in fields.items()])


def _searched(train, train_weights, query, model, known, k, partitions, limit):
    """The neighbours by indexes of the training rows, which are broadcast one pack of runs after the other."""
    rows = train.select("run", "id", *SCORES, "category")
    bags = _bags(train_weights, rows.select("run", "id"), []).join(rows, ["run", "id"])
    # a run that is larger than a broadcast is dealt into slices, each searched by itself
    slices = {run: -(-size // max(limit, 1)) if size > limit else 1 for run, size in known.items()}
    if len(set(slices.values()) | {1}) > 1:
        listed = F.create_map(*[x for run, n in slices.items() for x in (F.lit(run), F.lit(n))])
        bags = bags.withColumn("slice", F.pmod(F.xxhash64("id"), listed[F.col("run")]).cast("int"))
    else:
        bags = bags.withColumn("slice", F.lit(0))
    bags = runtime.stage(bags, "train-bags")
    ids = query.select("run", "id", *SCORES).repartition(partitions, "id")
    asked = _bags(model.transform(query, SCORES, partitions, limit, numbered=True), ids, list(SCORES))
    units = {(run, part): known[run] // slices[run] for run in known for part in range(slices[run])}
    groups = packs(units, limit)
    if len(groups) > 1:
        asked = runtime.stage(asked, "query-bags")
    found = [_search(bags, asked, group, k, partitions if len(groups) > 1 else None) for group in groups]
    result = reduce(DataFrame.unionByName, found)
    if max(slices.values(), default=1) > 1:  # the best of a run's slices
        order = Window.partitionBy("run", "id").orderBy("distance2", "train_id")
        result = result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return result


def _search(bags: DataFrame, asked: DataFrame, units: list[tuple[int, int]], k: int, partitions: int | None) -> DataFrame:
    runs = sorted({run for run, _ in units})
    chosen = reduce(lambda a, b: a | b, [(F.col("run") == run) & (F.col("slice") == part) for run, part in units])
    table = bags.filter(chosen).toArrow()  # of checked size
    run_, slice_ = (table[c].to_numpy() for c in ("run", "slice"))
    indexes = {unit: tuple(postings.build(table.filter(pa.array((run_ == unit[0]) & (slice_ == unit[1]))))) for unit in units}
    sent = bags.sparkSession.sparkContext.broadcast({unit: x for unit, x in indexes.items() if len(x[0])})
    if partitions is not None:
        asked = asked.filter(F.col("run").isin(runs)).repartition(partitions, "id")
    kinds = dict(asked.dtypes)
    names = ["run", "id", "rank", "train_id", "category", "distance2"]
    schema = f"run int, id {kinds['id']}, rank int, train_id {kinds['id']}, category string, distance2 double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for (run, _), x in sent.value.items():
            held.setdefault(run, []).append(postings.Index(*x))
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("run", "id", *SCORES, "blocks")]
            out = {name: [] for name in names}
            for place, (run, own, one, two, blocks) in enumerate(zip(*columns, strict=True)):
                terms, weights, sorts = (batch.column(c)[place].values.to_numpy(zero_copy_only=False) for c in ("terms", "weights", "kinds"))
                for index in held.get(run, []):
                    at, distance, _ = postings.nearest(index, terms, weights, sorts, (one, two), min(k, len(index.ids)))
                    n = len(at)
                    out["run"] += [run] * n
                    out["id"] += [own] * n
                    out["rank"] += range(1, n + 1)
                    out["train_id"] += index.ids[at].tolist()
                    out["category"] += [index.category[i] for i in at.tolist()]
                    out["distance2"] += (np.round(distance + blocks, 9) + 0.0).tolist()
            yield pa.RecordBatch.from_pydict(
                {
                    "run": pa.array(out["run"], pa.int32()),
                    "id": pa.array(out["id"], batch.schema.field("id").type),
                    "rank": pa.array(out["rank"], pa.int32()),
                    "train_id": pa.array(out["train_id"], batch.schema.field("id").type),
                    "category": pa.array(out["category"], pa.string()),
                    "distance2": pa.array(out["distance2"], pa.float64()),
                }
            )

    return asked.select("run", "id", *SCORES, "blocks", "terms", "weights", "kinds").mapInArrow(work, schema)


def clustered(rows: DataFrame) -> DataFrame:
    """``rows`` with bags, on partitions by ``cluster``: rows that are alike in their short blocks, all but the first, or a part of these.

    A pack of one cluster can be told to be too far from a query without its first block, which has nearly all the terms.
    """
    alike = F.xxhash64(*[F.array_sort(F.col("bag")[i]) for i in range(1, len(features.BLOCKS))])
    total = rows.agg(F.sum(F.size(F.flatten("bag")))).first()[0] or 0
    hot = rows.groupBy(alike.alias("alike")).count().filter(F.col("count") > CLUSTER_ROWS)
    # at most one row for each CLUSTER_ROWS rows
    hot = runtime.stage(hot.select("alike", F.ceil(F.col("count") / CLUSTER_ROWS).alias("parts")), "hot-clusters")
    placed = rows.withColumn("alike", alike).join(F.broadcast(hot), "alike", "left")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("cluster", F.xxhash64("alike", part)).drop("alike", "parts")
    # a partition has some packs, so that rows of a cluster share one
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // (PACKS_PER_TASK * PACK_TERMS)))
    found = placed.repartition(parts, "cluster")
    found.parts = parts
    return found


def with_clusters(drawn: DataFrame, posts: DataFrame, limit: int) -> DataFrame:
    """The rows of ``drawn(run, id, ...)`` with what ``posts``, by ``clustered``, have of them, on the partitions of the posts."""
    if runtime.fits_broadcast(drawn, limit):
        return posts.join(F.broadcast(drawn), "id")
    places = posts.select("id", "cluster")
    named = runtime.stage(drawn.join(places, "id"), "drawn-clusters").repartition(posts.parts, "cluster")
    return posts.join(named, ["cluster", "id"])


def _dealt(train: DataFrame, query: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """The neighbours by packs of both sides, for samples of any size."""
    width = len(features.BLOCKS)
    train, query = (rows if "cluster" in rows.columns else clustered(rows) for rows in (train, query))
    given = _packs(train.select("run", "id", *SCORES, "category", "bag", "cluster"), PACK_ROWS, "train")
    asked = _packs(query.select("run", "id", *SCORES, "bag", "cluster"), QUERY_PACK_ROWS, "query")
    each = given.select("run", F.explode(F.arrays_zip("terms", "held")).alias("entry"))
    found = runtime.stage(each.groupBy("run", F.col("entry.terms").alias("term")).agg(F.sum("entry.held").cast("int").alias("df")), "pack-terms")
    given, asked = _with_frequencies(given, found, "train"), _with_frequencies(asked, found, "query")
    # few bytes for the work they make: every task has some packs of queries, and of training rows as many as leave tasks for all cores
    parts = -(-asked.count() // ASKED_PER_TASK) or 1
    asked = asked.repartition(parts).select(*[F.col(c).alias(f"own_{c}") for c in asked.columns])
    wide = max(-(-4 * query.sparkSession.sparkContext.defaultParallelism // parts), -(-given.count() // GIVEN_PER_TASK))
    # not a join on a key: a run's packs are not to come together in one task
    pairs = given.repartition(wide).join(asked.hint("shuffle_replicate_nl"), F.col("run") - F.col("own_run") == 0)
    kind = dict(query.dtypes)["id"]
    schema = f"run int, id {kind}, train_id {kind}, category string, distance2 double"

    def best(nearest: postings.Nearest) -> pa.RecordBatch:
        place, distance, ids, category = nearest.found()
        return pa.RecordBatch.from_pydict(
            {
                "run": pa.array(np.full(len(place), nearest.asked.run), pa.int32()),
                "id": pa.array(nearest.asked.head.ids[place]),
                "train_id": pa.array(ids),
                "category": pa.array(category, pa.string()),
                "distance2": pa.array(distance),
            }
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = [], {}

        def pack(batch: pa.RecordBatch, side: str, row: int) -> postings.Rows:
            number, run, head, body, df = (batch.column(f"{side}{name}")[row].as_py() for name in ("number", "run", "head", "body", "df"))
            return postings.Rows(number, run, head, body, df, sizes[run], width)

        def meet() -> None:
            for nearest in asked.values():
                nearest.meet([given for given in held if given.run == nearest.asked.run])
            held.clear()

        for batch in batches:
            numbers, others = (batch.column(c).to_pylist() for c in ("number", "own_number"))
            for row, (number, other) in enumerate(zip(numbers, others, strict=True)):
                if not held or held[-1].number != number:
                    if len(held) >= MET_AT_ONCE:  # all of them have come with every pack of queries of their run
                        meet()
                    held.append(pack(batch, "", row))
                if other not in asked:
                    asked[other] = postings.Nearest(pack(batch, "own_", row), k)
        meet()
        yield from map(best, asked.values())

    order = Window.partitionBy("run", "id").orderBy("distance2", "train_id")
    nearest = pairs.mapInArrow(work, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return nearest.select("run", "id", "rank", "train_id", "category", "distance2")


def _packs(rows: DataFrame, most_rows: int, label: str) -> DataFrame:
    """``run, number, head, body, terms, held``, staged: packs of rows, and in how many of its rows each of a pack's terms is."""
    width, most_terms = len(features.BLOCKS), PACK_TERMS
    sorted_ = rows.sortWithinPartitions("run", "cluster").drop("cluster")
    schema = "run int, head binary, body binary, terms array<bigint>, held array<int>"
    found = sorted_.mapInArrow(lambda batches: postings.packs(batches, width, most_rows, most_terms), schema)
    conf = rows.sparkSession.conf
    kept = conf.get(ALL_KEYS)
    conf.set(ALL_KEYS, "false")  # rows that meet on cluster and id stay on the partitions of the clusters
    try:
        return runtime.number_rows(found, "number", f"{label}-packs")
    finally:
        conf.set(ALL_KEYS, kept)


def _with_frequencies(found: DataFrame, frequencies: DataFrame, label: str) -> DataFrame:
    """``run, number, head, body, df``, staged: the packs, which go, with the number of training rows of the run that each of their terms is in."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], ["number", "df"])

        for batch in batches:
            numbers, df = batch.column("number").to_numpy(), batch.column("df").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for start, stop in zip(edges, edges[1:]):  # noqa: B905
                if start < stop and numbers[start] != now:
                    if held:
                        yield out()
                    now, held = int(numbers[start]), []
                if start < stop:
                    held.append(df[start:stop].astype(np.int32))
        if held:
            yield out()

    each = found.select("run", "number", F.posexplode("terms").alias("place", "term")).join(frequencies, ["run", "term"], "left")
    # lists grow in the tasks, one at a time: as aggregates, a hundred of them would be on the heap as objects
    each = each.select("number", "place", F.coalesce("df", F.lit(0)).cast("int").alias("df")).repartition("number").sortWithinPartitions("number", "place")
    known = each.select("number", "df").mapInArrow(lists, "number long, df binary")
    met = found.join(known, "number", "left").select("run", "number", "head", "body", F.coalesce("df", F.lit(b"")).alias("df"))
    met = runtime.stage(met, f"{label}-weighed", PACKS_PER_FILE)
    runtime.unstage(found)
    return met


def _joined(train, train_weights, query, model, k, partitions, broadcast_limit):
    """The neighbours by joins on the term, for samples of any size."""
    filled = train_weights.groupBy("run", "id").agg(F.max("blocks").alias("blocks"))
    train_rows = runtime.stage(
        train.select("run", "id", *SCORES, "category").join(filled, ["run", "id"], "left").fillna({"blocks": 0}),
        "train-rows",
    )
    query_weights = model.transform(query, SCORES, partitions, broadcast_limit)
    first = _first_without_terms(train_rows, query, k, partitions, broadcast_limit)
    return _nearest(query_weights, train_weights, train_rows, first, model, k, broadcast_limit)


def _nearest(query_weights, train_weights, train_rows, first, model, k, broadcast_limit):
    """The k nearest of the pairs that share a term and of the ``first`` ones, query by query."""
    shared = _shared_terms(query_weights, train_weights, model, broadcast_limit)
    candidate = ["run", "id", "train_id"]
    dots = shared.unionByName(first).groupBy(*candidate).agg(
        F.sum("part").alias("dot"),
        F.max("query_blocks").alias("query_blocks"),
        *[F.max(score).alias(score) for score in SCORES],
    )
    other = train_rows.select(
        "run", F.col("id").alias("train_id"), F.col("blocks").alias("train_blocks"), "category",
        *[F.col(score).alias(f"train_{score}") for score in SCORES],
    )
    met = dots.join(runtime.small_side(other, broadcast_limit), ["run", "train_id"])
    gap = sum(((F.col(s) - F.col(f"train_{s}")) * (F.col(s) - F.col(f"train_{s}")) for s in SCORES), F.lit(0.0))
    closeness = F.round(F.col("train_blocks") - F.lit(2.0) * F.col("dot") + gap, 9)
    by_query = Window.partitionBy("run", "id")
    nearest = (
        met.select(*candidate, "category", "query_blocks", closeness.alias("_relative"))
        .withColumn("rank", F.row_number().over(by_query.orderBy("_relative", "train_id")))
        .filter(F.col("rank") <= k)
    )
    # a candidate of the second kind does not know how many blocks its query has
    return nearest.select(
        "run", "id", "rank", "train_id", "category",
        F.round(F.col("_relative") + F.max("query_blocks").over(by_query), 9).alias("distance2"),
    )


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({score: scalars.round_half_even(F.col(score)) for score in SCORES})


def packs(sizes: dict, limit: int) -> list[list]:
    """Runs in groups whose sizes add up to ``limit`` at most; a larger run stays alone."""
    groups, room = [], []
    for run, size in sorted(sizes.items(), key=lambda item: (-item[1], item[0])):
        place = next((i for i, left in enumerate(room) if left >= size), None)
        if place is None:
            groups.append([])
            room.append(max(limit - size, 0))
            groups[-1].append(run)
        else:
            groups[place].append(run)
            room[place] -= size
    return groups


def _shared_terms(query_weights, train_weights, model, broadcast_limit):
    """One row per shared term of a query and a training row."""
    left = query_weights.select(
        *features.TERM, "id", *SCORES, F.col("weight").alias("_q"), F.col("blocks").alias("query_blocks"), "df"
    )
    right = train_weights.select(*features.TERM, F.col("id").alias("train_id"), F.col("weight").alias("_t"), "df")
    keys = list(features.TERM)
    if runtime.fits_broadcast(right, broadcast_limit):
        # the queries stay where they are, and so do all later steps by query
        joined = left.drop("df").join(F.broadcast(right.drop("df")), keys)
    else:
        # A term of a third of the posts is spread over a third of the shuffle
        # partitions: query rows take one of its salts, training rows all of them.
        width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sizes = F.broadcast(model.sizes)
        salts = F.greatest(F.ceil(F.col("df") / F.col("n") * F.lit(width)), F.lit(1)).cast("int")
        left = left.join(sizes, "run").withColumn("salt", F.pmod(F.hash("id"), salts)).drop("df", "n")
        right = (
            right.join(sizes, "run")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
            .drop("df", "n")
        )
        joined = left.join(right, [*keys, "salt"])
    return joined.select(
        "run", "id", "train_id", (F.col("_q") * F.col("_t")).alias("part"), "query_blocks", *SCORES
    )


def _first_without_terms(train_rows, query, k, partitions, broadcast_limit):
    """For every query the ``k`` training rows nearest by blocks and scores alone."""
    # at most k rows for each of the 4 x 201 x 101 possible cells of a run
    cell = Window.partitionBy("run", "blocks", *SCORES).orderBy("id")
    cells = (
        train_rows.withColumn("_place", F.row_number().over(cell))
        .filter(F.col("_place") <= k)
        .select("run", "blocks", *SCORES, F.col("id").alias("train_id"))
    )
    cells = runtime.stage(cells, "cells")
    # at most 201 x 101 rows per run, dealt into so many slices that no task gets too many distances
    places = runtime.stage(query.groupBy("run", *SCORES).agg(F.count(F.lit(1)).alias("queries")), "score-pairs")
    work = places.groupBy("run").count().join(cells.groupBy("run").agg(F.count(F.lit(1)).alias("cells")), "run")
    most = work.agg(F.max(F.col("count") * F.col("cells")).alias("most")).first()["most"] or 0
    slices = -(-most // CELLS_PER_TASK) or 1
    dealt = places.withColumn("slice", F.pmod(F.hash(*SCORES), F.lit(slices)))
    copies = cells.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    found = (
        dealt.select("run", "slice", *SCORES)
        .groupBy("run", "slice")
        .cogroup(copies.groupBy("run", "slice"))
        .applyInPandas(
            lambda left, right: _nearest_cells(left, right, k),
            "run int, sentiment double, subjectivity double, train_id long",
        )
    )
    found = runtime.stage(found, "nearest-cells")
    ids = query.select("run", "id", *SCORES).repartition(partitions, "id")
    keys = ["run", *SCORES]
    if runtime.fits_broadcast(found, broadcast_limit):
        met = ids.join(F.broadcast(found), keys)
    else:
        # most posts share one pair of scores: a pair is spread by its share of the queries
        width = int(query.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        total = query.count()
        salts = F.greatest(F.ceil(F.col("queries") / F.lit(total) * F.lit(width)), F.lit(1)).cast("int")
        spread = runtime.stage(places.select(*keys, salts.alias("salts")), "score-salts")
        # as long as the calendar of score pairs: at most 201 x 101 rows a run, checked
        placed = ids.join(runtime.small_side(spread), keys).withColumn("salt", F.pmod(F.hash("id"), F.col("salts"))).drop("salts")
        lists = found.join(spread, keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        met = placed.join(lists, [*keys, "salt"])
    return met.select("run", "id", "train_id", F.lit(0.0).alias("part"), F.lit(0).alias("query_blocks"), *SCORES)


def _nearest_cells(places: pd.DataFrame, cells: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest cells of each place, a bounded number of places at a time."""
    blocks, ids = cells["blocks"].to_numpy(), cells["train_id"].to_numpy()
    scores = [cells[score].to_numpy() for score in SCORES]
    out = {"run": [], **{score: [] for score in SCORES}, "train_id": []}
    step = max(1, 2_000_000 // max(len(cells), 1))
    for at in range(0, len(places) if len(cells) else 0, step):
        part = places.iloc[at : at + step]
        own = [part[score].to_numpy()[:, None] for score in SCORES]
        distance = np.round(blocks + (scores[0] - own[0]) ** 2 + (scores[1] - own[1]) ** 2, 9)
        limit = np.partition(distance, k - 1, axis=1)[:, k - 1] if len(cells) > k else np.full(len(part), np.inf)
        row, cell = np.nonzero(distance <= limit[:, None])
        order = np.lexsort((ids[cell], distance[row, cell], row))
        row, cell = row[order], cell[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, cell = row[place < k], cell[place < k]
        out["run"].append(part["run"].to_numpy()[row])
        for score in SCORES:
            out[score].append(part[score].to_numpy()[row])
        out["train_id"].append(ids[cell])
    return pd.DataFrame({name: np.concatenate(values) if values else [] for name, values in out.items()})


def votes(nearest: DataFrame, ks: list[int]) -> DataFrame:
    """The majority class of the first ``k`` neighbours, for each k; the smallest name wins ties.

    One search with the largest k serves all of them.
    """
    each = nearest.select("run", "id", "rank", "category", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    counts = (
        each.filter(F.col("rank") <= F.col("k"))
        .groupBy("run", "id", "k", "category")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.min(F.struct((-F.col("_n")).alias("_n"), F.col("category"))).alias("_best")
    return counts.groupBy("run", "id", "k").agg(best).select(
        "run", "id", "k", F.col("_best.category").alias("prediction")
    )


def classify(train: DataFrame, query: DataFrame, ks: list[int], broadcast_limit: int | None = None) -> DataFrame:
    """Predicted class of every query row, for each k: run, id, k, prediction."""
    return votes(neighbours(train, query, max(ks), broadcast_limit), ks)
