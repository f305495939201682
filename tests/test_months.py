"""Months over a stream: late rows are merged, rows far too late set apart, nothing counted twice."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from postlens.sources import commits
from postlens.streaming import months
from tests.conftest import rows

KEYS = T.StructType([T.StructField("kind", T.StringType())])
DAY = datetime.timedelta(days=1)


def frame(spark, *listed):
    """Rows of (day as text or None, kind)."""
    own = [(None if d is None else datetime.datetime.fromisoformat(d).replace(tzinfo=datetime.UTC), k) for d, k in listed]
    return spark.createDataFrame(own, "at timestamp, kind string")


def add(spark, folder, key, *listed, too_late=60):
    return months.add_batch(frame(spark, *listed), "at", ["kind"], folder, key, DAY, too_late * DAY)


def test_late_rows_are_merged_and_far_too_late_ones_set_apart(spark, tmp_path):
    folder = f"{tmp_path}/m"
    assert rows(months.months(spark, folder, KEYS), "n") == [] and months.watermark(spark, folder) is None
    add(spark, folder, "0", ("2021-01-05", "a"), ("2021-02-01T23:00:00", "a"), ("2021-01-31T23:59:59", "b"))
    assert months.watermark(spark, folder) == datetime.datetime(2021, 1, 31, 23, tzinfo=datetime.UTC)
    assert not months.months(spark, folder, KEYS).where("closed").count()
    add(spark, folder, "1", ("2021-01-20", "a"), ("2021-03-15", "a"))  # january was still open
    add(spark, folder, "2", ("2021-01-21", "a"), ("2021-04-20", None))  # closed by now
    assert add(spark, folder, "3", ("2021-01-22", "a"), ("2020-12-31", "b"), (None, "a"))
    first, last = datetime.date(2021, 1, 1), datetime.date(2021, 4, 1)
    found = {(m, k): (n, late, closed) for m, k, n, late, closed in rows(months.months(spark, folder, KEYS), "month", "kind", "n", "n_late", "closed")}
    assert found[first, "a"] == (3, 1, True) and found[first, "b"] == (1, 0, True) and found[last, None] == (1, 0, False)
    assert rows(months.too_late_rows(spark, folder, KEYS), "month", "kind", "n") == [(datetime.date(2020, 12, 1), "b", 1), (first, "a", 1), (None, "a", 1)]
    assert {m for m, _ in found} - {m for (m,) in rows(months.months(spark, folder, KEYS, closed_only=True), "month")} == {last}


def test_a_batch_counts_once_also_after_compaction(spark, tmp_path):
    folder = f"{tmp_path}/m"
    for key in "0101":
        add(spark, folder, key, ("2021-01-05", "a"), (f"2021-0{int(key) + 1}-06", "b"))
    before = rows(months.months(spark, folder, KEYS), "month", "kind", "n", "n_late", "closed")
    assert sum(r[2] for r in before) == 4
    months.compact(spark, folder, KEYS)
    assert len(commits.manifests(spark, folder)) == 1
    assert rows(months.months(spark, folder, KEYS), "month", "kind", "n", "n_late", "closed") == before
    assert not add(spark, folder, "1", ("2021-01-05", "a"))
    assert commits.remove_uncommitted(spark, folder) == [f"{t}/commit={k}" for t in ("counts", "too_late") for k in "01"]
    assert rows(months.months(spark, folder, KEYS), "month", "kind", "n", "n_late", "closed") == before


def test_an_empty_batch_leaves_the_watermark(spark, tmp_path):
    folder = f"{tmp_path}/m"
    add(spark, folder, "0", ("2021-01-05", "a"))
    mark = months.watermark(spark, folder)
    add(spark, folder, "1")
    assert months.watermark(spark, folder) == mark and months.months(spark, folder, KEYS).count() == 1


@pytest.mark.parametrize("parts", [1, 4])
def test_a_stream_in_any_number_of_runs_gives_the_counts_of_one_batch(spark, tmp_path, parts):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    time = next(f.name for f in events.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)))
    key = next(f.name for f in events.schema.fields if isinstance(f.dataType, T.StringType))
    keys = T.StructType([T.StructField(key, T.StringType())])
    own = events.select(F.col(time).cast("timestamp").alias("at"), key)
    box, folder = f"{tmp_path}/box", f"{tmp_path}/m"

    def run():
        stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(box)
        months.count_months(stream, "at", [key], folder, f"{tmp_path}/check", too_late=40_000 * DAY).awaitTermination()

    for part in range(parts):  # dealt by hash: every part reaches over all months, so most rows of later ones are late
        own.where(F.pmod(F.xxhash64("at", key), F.lit(parts)) == part).coalesce(2).write.mode("append").parquet(box)
        run()
    run()  # nothing new
    expected = Counter((a.strftime("%Y-%m-01"), k) for a, k in own.select(F.date_trunc("month", "at"), key).collect())
    got = months.months(spark, folder, keys)
    assert {(str(m), k): n for m, k, n in rows(got, "month", key, "n")} == dict(expected)
    assert (got.agg(F.sum("n_late")).first()[0] > 0) == (parts > 1) or got.select("month").distinct().count() == 1
    assert months.too_late_rows(spark, folder, keys).count() == 0
