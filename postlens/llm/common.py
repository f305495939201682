"""What the operators of this subpackage share: reading texts, Arrow batches, linked groups."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlens.runtime import scratch_path, spread, stage

# Bytes of text that a task works on at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text, null as empty; whatever else ``docs`` holds cannot clash."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def stage_packed(df: DataFrame, label: str) -> DataFrame:
    """``stage`` for texts and long binaries, with the denser compression."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` again, in runs of about ``limit`` bytes of ``text``; one text is never cut."""
    for batch in batches:
        start = size = 0
        for row, length in enumerate(pa.compute.binary_length(batch.column("text")).to_pylist()):
            if size and size + length > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if batch.num_rows > start:
            yield batch.slice(start)


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """A text column as UTF-8."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def map_texts(docs: DataFrame, work: Callable[[pa.RecordBatch], dict | None], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``work`` on runs of rows; it returns the columns of its result by name.

    ``work`` may also be a factory's product: it is built once per task if it
    has an attribute ``per_task``.
    """
    names = [x.split()[0] for x in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = work() if getattr(work, "per_task", False) else work
        for part in slices(batches, limit):
            if (out := act(part)) is not None:
                yield pa.RecordBatch.from_pydict({n: out[n] for n in names})

    return docs.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    fields, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            fields.append(schema[start:i])
            start = i + 1
    return [x.strip() for x in [*fields, schema[start:]]]


def per_task(factory: Callable) -> Callable:
    """Mark ``factory``: a task calls it once and uses what it returns for all its rows."""
    factory.per_task = True
    return factory


def worker_state(name: str, build: Callable):
    """What ``build`` makes, kept for as long as the Python worker lives.

    The functions of this subpackage arrive by value with each task, so their own
    globals are new each time; a module made at run time is not.
    """
    held = sys.modules.setdefault("_postlens_worker", types.ModuleType("_postlens_worker")).__dict__
    if name not in held:
        held[name] = build()
    return held[name]


def linked_groups(edges: DataFrame, label: str) -> DataFrame:
    """``(node, root)`` for all nodes of ``edges(a, b)``; root is the smallest node that can be reached.

    Alternating stars: each node hands its larger neighbours to the smallest
    node that it knows, then its smaller ones. The nodes on the way are never
    gathered, the smallest neighbour is an aggregate with partial sums, and the
    two joins read staged tables, so that a node with very many links is split.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges")
    before = None
    while True:
        for both in (True, False):
            links = edges.union(edges.select("b", "a")) if both else edges
            least = stage(links.groupBy("a").agg(F.least("a", F.min("b")).alias("root")), f"{label}-least")
            found = links.join(least, "a")
            if both:
                found = found.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
            else:
                found = found.where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b")).union(least.select("a", F.col("root").alias("b")))
            edges = stage(found.distinct(), f"{label}-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        before = now


def hex64(value: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
