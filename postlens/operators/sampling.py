"""Exact-size samples and splits that draw the same rows on every run.

Each row gets a number from a hash of its id, and the rows with the smallest
numbers are drawn. So a sample is known once its last row is: ``cut_points``
finds that row for each group, with histograms instead of sorts, and every row
can then tell by itself whether it is in. Neither a sample of billions nor a hot
class is ever brought together, and no row is joined by its id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from postlens import runtime
from postlens.functions import scalars

BUCKETS = 4096
# Groups of up to this many rows are ranked directly.
RANKABLE_ROWS = 200_000


def levels_for(count: int) -> int:
    """How often to narrow a group of at most ``count`` rows before ranking it."""
    levels = 0
    while count > RANKABLE_ROWS:
        # a twentieth of the buckets: room for keys that are not spread evenly
        count //= BUCKETS // 20
        levels += 1
    return levels


def cut_points(
    rows: DataFrame, quotas: DataFrame, group: list[str], key: str, tie: str, levels: int
) -> DataFrame:
    """The last row taken of each group: its columns, ``_cut_key`` and ``_cut_tie``.

    Taken are the ``quota`` rows with the smallest (``key``, ``tie``). ``quotas``
    has the columns of ``group`` and ``quota``; a group is there once, with a
    quota of 1 up to its number of rows. Every level narrows a group down to one
    of 4096 key intervals; only what is then left is ranked. ``rows`` is read
    several times and should be staged.
    """
    undecided = rows.select(*group, key, tie)
    for _ in range(levels):
        undecided, quotas = _narrow(undecided, quotas, group, key)
    order = Window.partitionBy(*group).orderBy(key, tie)
    last = (
        undecided.join(quotas, group)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == F.col("quota"))
        .select(*group, F.col(key).alias("_cut_key"), F.col(tie).alias("_cut_tie"))
    )
    return runtime.stage(last, "cut-points")


def _narrow(rows: DataFrame, quotas: DataFrame, group: list[str], key: str):
    """The rows of the interval in which each group is cut, and the quotas left for them."""
    span = rows.groupBy(*group).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    span = runtime.stage(span, "key-spans")
    width = F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300))
    bucket = F.least(F.floor((F.col(key) - F.col("_low")) / width * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    placed = rows.join(runtime.small_side(span), group).withColumn("_bucket", bucket).drop("_low", "_high")

    # at most 4096 rows per group from here on
    running = Window.partitionBy(*group).orderBy("_bucket")
    histogram = placed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = histogram.withColumn("_upto", F.sum("_n").over(running))
    cut = (
        histogram.join(quotas, group)
        .filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(*group, "_bucket", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("quota"))
    )
    cut = runtime.stage(cut, "key-cuts")
    left = placed.join(runtime.small_side(cut.drop("quota")), [*group, "_bucket"], "left_semi").drop("_bucket")
    return runtime.stage(left, "undecided"), cut.drop("_bucket")


def within(key: str, tie: str) -> Column:
    """Whether a row that carries the cut point of its group is taken."""
    before = F.col(key) < F.col("_cut_key")
    return before | ((F.col(key) == F.col("_cut_key")) & (F.col(tie) <= F.col("_cut_tie")))


def draw_key(seed: Column | str, tie: Column, weight: Column) -> Column:
    """Sampling key of a weighted draw without replacement: the smaller, the earlier drawn.

    The logarithm of the exponential clock -ln(u) / weight keeps the key evenly
    spread over many orders of magnitude of weights (Efraimidis and Spirakis 2006).
    """
    return F.log(-F.log(scalars.unit_hash(seed, tie)) / weight)


def key_limit(classes: list[tuple[float, int]], wanted: int, slack: float = 1.0) -> float:
    """A draw key that, going by chance, more than ``wanted`` rows stay below.

    ``classes`` lists weights and numbers of rows. Used to leave most rows out
    early; the caller has to count what is left.
    """
    goal = wanted + slack * (100 + 10 * math.sqrt(wanted))
    if goal >= sum(count for _, count in classes):
        return math.inf
    low, high = -60.0, 60.0
    for _ in range(80):
        middle = (low + high) / 2
        clock = math.exp(middle)
        expected = sum(-count * math.expm1(-weight * clock) for weight, count in classes)
        low, high = (low, middle) if expected >= goal else (middle, high)
    return high


def resolve_size(size: int | float, available: int) -> int:
    """A sample size as a row count; a fraction below 1 is a share of the rows."""
    wanted = int(available * size) if isinstance(size, float) and size < 1 else int(size)
    if wanted > available:
        raise ValueError(f"cannot draw {wanted} of {available} rows without replacement")
    return wanted


def class_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Append the number of rows of each row's class as ``class_count``.

    The classes are counted first and the list is joined back, so a large class
    stays spread out.
    """
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("class_count"))
    return rows.join(runtime.small_side(runtime.stage(counts, "class-counts")), by)


def sample_uniform(rows: DataFrame, size: int | float, seed: str, key: str = "id") -> DataFrame:
    """Exactly ``size`` rows, each equally likely; ``rows`` should be staged."""
    return _sample(rows.withColumn("_weight", F.lit(1.0)), size, seed, key)


def sample_weighted(
    rows: DataFrame, size: int | float, seed: str, category: str = "category", key: str = "id"
) -> DataFrame:
    """Exactly ``size`` rows, drawn with weight (all rows - rows of the class), favouring rare classes."""
    weight = (F.lit(rows.count()) - F.col("class_count")).cast("double")
    weighted = class_counts(rows, [category]).withColumn("_weight", weight).drop("class_count")
    return _sample(weighted.filter(F.col("_weight") > 0), size, seed, key).select(*rows.columns)


def _sample(rows, size, seed, key):
    keyed = rows.withColumn("_key", draw_key(seed, F.col(key), F.col("_weight"))).withColumn("_group", F.lit(0))
    # one weight per class
    classes = [(r["_weight"], r["count"]) for r in rows.groupBy("_weight").count().collect()]
    wanted = resolve_size(size, sum(count for _, count in classes))
    slack, found = 1.0, -1
    while found < wanted:
        hopeful = keyed.select("_group", "_key", key).filter(F.col("_key") <= key_limit(classes, wanted, slack))
        narrow = runtime.stage(hopeful, "sample-keys")
        found, slack = narrow.count(), slack * 4
    quotas = rows.sparkSession.range(int(wanted > 0)).select(
        F.lit(0).alias("_group"), F.lit(wanted).cast("long").alias("quota")
    )
    cuts = cut_points(narrow, quotas, ["_group"], "_key", key, levels_for(found))
    # a single row
    taken = keyed.join(F.broadcast(cuts), "_group").filter(within("_key", key))
    return taken.drop("_key", "_group", "_weight", "_cut_key", "_cut_tie")


def split_rows(rows: DataFrame, group: list[str], seed: Column | str, share: float = 0.2, key: str = "id") -> DataFrame:
    """Append ``is_test``: in each group the rounded ``share`` of rows with the smallest hash.

    ``rows`` is read several times and should be staged.
    """
    counts = runtime.stage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), "group-counts")
    largest = counts.agg(F.max("_n").alias("n")).first()["n"] or 0
    quotas = counts.select(*group, F.round(F.col("_n") * F.lit(share)).cast("long").alias("quota"))
    keyed = rows.withColumn("_key", scalars.unit_hash(seed, F.col(key)))
    cuts = cut_points(keyed, quotas.filter("quota > 0"), group, "_key", key, levels_for(largest))
    marked = keyed.join(runtime.small_side(cuts), group, "left")
    return marked.withColumn("is_test", F.coalesce(within("_key", key), F.lit(False))).drop(
        "_key", "_cut_key", "_cut_tie"
    )


def stratified_split(rows: DataFrame, seed: str, share: float = 0.2, by: str = "category", key: str = "id") -> DataFrame:
    """Append ``is_test``, with the same share of test rows in every class."""
    return split_rows(rows, [by], seed, share, key)
