"""Several tables that change together: a batch is there once its manifest is.

A folder holds ``<table>/commit=<key>/...`` for each table and batch, and ``_commits``
with one small JSON file for each batch, named by its place in the order. A batch
writes all its tables first and its manifest last, under another name that is then
changed in one step. Readers only follow manifests, so they see all tables of a batch or
none. A batch that failed has left folders without a manifest; run again
under the same key it replaces them, and a batch whose manifest is there is not written
a second time. One writer at a time may commit to a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, types as T

MANIFESTS = "_commits"


def _path(spark: SparkSession, path: str):
    """The Hadoop path and its file system: any store that Spark reads."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str] | None:
    """The manifests' file names, in order; None if there is no place for them."""
    path, fs = _path(spark, f"{folder}/{MANIFESTS}")
    if not fs.exists(path):
        return None
    return sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(".json"))


def manifests(spark: SparkSession, folder: str) -> list[dict] | None:
    """The manifests in force, in order: from the last one that replaces all before it. None if the folder never had any.

    As many small files as there are batches; ``replaces`` batches start anew.
    """
    names = _names(spark, folder)
    if names is None:
        return None
    rows = spark.read.text([f"{folder}/{MANIFESTS}/{n}" for n in names], wholetext=True).collect() if names else []
    found = []
    for own in sorted((json.loads(r[0]) for r in rows), key=lambda x: x["place"]):
        found = [own] if own["replaces"] else [*found, own]
    return found


def committed_inputs(spark: SparkSession, folder: str) -> set[str]:
    """The input files of all batches in force."""
    return {x for own in manifests(spark, folder) or [] for x in own["inputs"]}


def commit(
    spark: SparkSession,
    folder: str,
    key: str,
    tables: dict[str, DataFrame],
    inputs: Iterable[str] = (),
    partition_by: str | None = None,
    replaces: bool = False,
    notes: dict | None = None,
) -> bool:
    """Write all ``tables`` as batch ``key``; whether it was written, False if it has been already, replaced or not.

    ``partition_by`` is a column of all tables, the same for all batches; its rows are gathered in
    few files of even size. With ``replaces`` readers see this batch and later ones only.
    ``notes`` are kept in the manifest.
    """
    names = _names(spark, folder) or []
    if any(n.endswith(f"-{key}.json") for n in names):
        return False
    for name, frame in tables.items():
        writer = (frame.hint("rebalance", partition_by) if partition_by else frame).write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{folder}/{name}/commit={key}")
    place = 1 + max((int(n.split("-")[0]) for n in names), default=-1)
    text = json.dumps({"key": key, "place": place, "replaces": replaces, "tables": sorted(tables), "inputs": sorted(inputs), "notes": notes or {}})
    draft, fs = _path(spark, f"{folder}/{MANIFESTS}/.{uuid.uuid4().hex}")
    final, _ = _path(spark, f"{folder}/{MANIFESTS}/{place:012d}-{key}.json")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"batch {key} could not be committed to {folder}")
    return True


def read(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame | None:
    """One table of all batches in force; None if the folder has no manifests."""
    found = manifests(spark, folder)
    if found is None:
        return None
    paths = [f"{folder}/{name}/commit={own['key']}" for own in found if name in own["tables"]]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(*paths).select(*schema.fieldNames())


def remove_uncommitted(spark: SparkSession, folder: str) -> list[str]:
    """Delete what failed batches, and batches that have been replaced, have left; not while one is being written."""
    kept = {f"commit={own['key']}" for own in manifests(spark, folder) or []}
    root, fs = _path(spark, folder)
    gone = []
    for table in fs.listStatus(root) if fs.exists(root) else []:
        if table.isDirectory() and table.getPath().getName() != MANIFESTS:
            for batch in fs.listStatus(table.getPath()):
                own = batch.getPath().getName()
                if own.startswith("commit=") and own not in kept:
                    fs.delete(batch.getPath(), True)
                    gone.append(f"{table.getPath().getName()}/{own}")
    return sorted(gone)
