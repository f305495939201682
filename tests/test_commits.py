"""Batches over several tables: all or nothing, and once only."""

import datetime

import pytest
from pyspark.sql import DataFrameWriter

from postlens.plans import jobs
from postlens.schemas import FAMILIES, LEXICON, RAW_POSTS, RAW_POSTS_FILE
from postlens.sources import commits, files
from postlens.streaming import inbox
from tests.conftest import rows
from tests.test_sources import BAD, GOOD, HEADER

SCHEMA = "id long, month string"


def table(spark, *ids):
    return spark.createDataFrame([(i, f"m{i % 2}") for i in ids], SCHEMA)


def seen(spark, folder, name):
    found = commits.read(spark, folder, name, table(spark).schema)
    return None if found is None else [i for i, _ in rows(found, "id", "month")]


def failing_at(monkeypatch, part):
    """Every write to a path that holds ``part`` fails."""
    real = DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        if part in path:
            raise OSError("lost")
        return real(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)


def test_a_batch_shows_in_all_tables_or_in_none(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/f"
    assert seen(spark, folder, "a") is None
    assert commits.commit(spark, folder, "one", {"a": table(spark, 1), "b": table(spark, 2)}, ["x"], "month")
    with monkeypatch.context() as m:
        failing_at(m, "/b/")
        with pytest.raises(OSError, match="lost"):
            commits.commit(spark, folder, "two", {"a": table(spark, 3), "b": table(spark, 4)}, ["y"], "month")
    assert (seen(spark, folder, "a"), seen(spark, folder, "b")) == ([1], [2])
    assert commits.committed_inputs(spark, folder) == {"x"}
    # run again it takes the place of what was left, and a third run changes nothing
    assert commits.commit(spark, folder, "two", {"a": table(spark, 3, 5), "b": table(spark, 4)}, ["y"], "month")
    assert not commits.commit(spark, folder, "two", {"a": table(spark, 3, 5), "b": table(spark, 4)}, ["y"], "month")
    assert (seen(spark, folder, "a"), seen(spark, folder, "b")) == ([1, 3, 5], [2, 4])


def test_a_batch_may_replace_all_before_it(spark, tmp_path):
    folder = f"{tmp_path}/f"
    for key, ids, replaces in (("one", [1], False), ("two", [2], True), ("three", [3], False)):
        commits.commit(spark, folder, key, {"a": table(spark, *ids)}, [key], replaces=replaces)
    assert seen(spark, folder, "a") == [2, 3] and commits.committed_inputs(spark, folder) == {"two", "three"}
    assert seen(spark, folder, "other") == []
    assert commits.remove_uncommitted(spark, folder) == ["a/commit=one"]
    assert seen(spark, folder, "a") == [2, 3]


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame([("good", 0.7, 0.6, 1.0)], LEXICON)


def captured(spark, folder, *ids):
    """A capture file in a folder whose name has to be quoted in addresses."""
    when = datetime.datetime(2021, 11, 1)
    posts = [(i, when + datetime.timedelta(days=20 * i), "me", "Me", f"good #tag{i}", 0, 0, 0, 0, None, f"['TAG{i}']", "k") for i in ids]
    frame = spark.createDataFrame(posts, f"{spark.createDataFrame([], RAW_POSTS)._jdf.schema().toDDL()}, capture string")
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/some keyword=100%")


def stored(spark, folder):
    return {name: rows(files.read_family(spark, folder, name), "id") for name in FAMILIES}


def test_processing_a_folder_may_be_repeated(spark, tmp_path, lexicon, monkeypatch):
    box, out = f"{tmp_path}/captures", f"{tmp_path}/out"
    captured(spark, box, 1, 2)
    jobs.process_files(spark, box, lexicon, out)
    first = stored(spark, out)
    assert first["posts"] == first["hashtags"] == [(1,), (2,)]
    jobs.process_files(spark, box, lexicon, out)
    assert stored(spark, out) == first
    captured(spark, box, 3)
    with monkeypatch.context() as m:
        failing_at(m, f"{out}/mentions/")
        with pytest.raises(OSError, match="lost"):
            jobs.process_files(spark, box, lexicon, out)
    assert stored(spark, out) == first
    for _ in range(2):
        jobs.process_files(spark, box, lexicon, out)
        assert stored(spark, out)["posts"] == [(1,), (2,), (3,)] and stored(spark, out)["hashtag_lists"] == [(1,), (2,), (3,)]
    assert files.read_family(spark, out, "posts").select("month").distinct().count() == 2
    jobs.process_files(spark, box, lexicon, out, mode="overwrite")
    assert stored(spark, out)["posts"] == [(1,), (2,), (3,)]
    with pytest.raises(ValueError, match="mode"):
        jobs.process_files(spark, box, lexicon, out, mode="ignore")


def test_a_failed_batch_of_the_inbox_leaves_nothing_twice(spark, tmp_path, lexicon, monkeypatch):
    box, out, no = (f"{tmp_path}/{n}" for n in ("box", "out", "no"))
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "a.csv").write_text(HEADER + "\n".join(GOOD + BAD))

    def run():
        inbox.ingest_inbox(spark, box, lexicon, out, f"{tmp_path}/check", rejects=no).awaitTermination()

    with monkeypatch.context() as m:
        failing_at(m, f"{out}/mentions/")
        with pytest.raises(Exception, match="lost"):
            run()
    assert commits.manifests(spark, out) is None
    run()
    run()
    own = commits.manifests(spark, out)
    assert len(own) == 1 and not own[0]["key"].startswith("None")
    assert inbox.processed(spark, out, "posts").count() == 3
    assert spark.read.option("recursiveFileLookup", "true").parquet(no).count() == 5
    assert RAW_POSTS_FILE.fieldNames()[0] == "_row"
