"""The whole chain from an archive to the predictions, through files."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postlens import runtime
from postlens.plans import jobs
from postlens.schemas import HASHTAG_CLASSES, LEXICON, RAW_POSTS
from postlens.sources import files
from tests.conftest import rows

CLASSES = [(1, "home", 5, 0, 1, 0, 0), (2, "vote", 5, 0, 0, 1, 0), (3, "stayed", 1, 1, 1, 0, 0)]


def test_chain(spark, tmp_path):
    rng = random.Random(4)
    listed = []
    for i in range(120):
        tag = rng.choice(["home", "vote", "stayed"])
        content = f"keyword {tag} talk about {tag} good #{tag} http://x.y/{i}"
        when = datetime.datetime(2021, 11, 1) + datetime.timedelta(hours=18 * i)
        listed.append((i, when, "me", "Me", content, 0, 0, 0, 0, None, f"['{tag.upper()}']"))
    archive = (
        spark.createDataFrame(listed, RAW_POSTS)
        .withColumn("lang", F.lit("en"))
        .withColumn("url", F.concat(F.lit("u"), F.col("id")))
    )
    lexicon = spark.createDataFrame([("good", 0.7, 0.6, 1.0)], LEXICON)
    classes = spark.createDataFrame(CLASSES, HASHTAG_CLASSES)
    captures, families, topics, labelled, out = (
        f"{tmp_path}/{name}" for name in ("captures", "families", "topics", "labelled", "out")
    )
    november, january = datetime.date(2021, 11, 1), datetime.date(2022, 1, 20)

    jobs.capture_months(archive, "Keyword", november, january, captures)
    stored = files.read_captures(spark, captures)
    assert stored.count() == 120
    assert rows(stored.select("capture").distinct(), "capture") == [(f"Keyword/en/{m}-01",) for m in ("2021-11", "2021-12", "2022-01")]
    jobs.process_files(spark, captures, lexicon, families)
    posts = files.read_family(spark, families, "posts")
    assert posts.count() == 120 and posts.select("month").distinct().count() == 3
    jobs.assign_topics(spark, families, topics, topics=3, passes=2)
    jobs.base_analysis(spark, families, topics, out)
    header = {"header": "true", "inferSchema": "true"}
    counts = spark.read.options(**header).csv(f"{out}/ngrams")
    for file in Path(out, "ngrams").rglob("*.csv"):
        ordered = [int(line.rsplit(",", 1)[1]) for line in file.read_text().splitlines()[1:]]
        assert ordered == sorted(ordered, reverse=True)
    assert rows(counts.select("category", "ngram_type").distinct(), "category", "ngram_type") == [
        ("hashtag", "unigram"), ("tweet", "bigram"), ("tweet", "trigram"), ("tweet", "unigram"),
    ]
    assert spark.read.options(**header).csv(f"{out}/collated_ngrams").count() == counts.count()
    assert spark.read.options(**header).csv(f"{out}/posts").count() == 120

    jobs.label_stored_posts(spark, families, classes, labelled)
    earlier = posts.filter(F.col("month") < datetime.date(2022, 1, 1)).count()
    assert spark.read.parquet(labelled).count() == earlier
    jobs.evaluate_grid(spark, labelled, f"{out}/grid", sample_range=[40], neighbour_range=[3])
    assert spark.read.options(**header).csv(f"{out}/grid/keys").count() == 5
    jobs.compare_methods(spark, labelled, f"{out}/methods", samples=40, k=3)
    assert spark.read.options(**header).csv(f"{out}/methods/samples=40/k=3/survivor").count() > 0

    jobs.capture_held_out(archive, "keyword", f"{tmp_path}/raw")
    jobs.predict_month(spark, labelled, families, f"{tmp_path}/raw", out, samples=60, k=3)
    # every job has removed what it had staged
    assert not list(Path(runtime.shared_folder(spark).removeprefix("file:"), "postlens").glob("job-*"))
    predicted = spark.read.options(**header).csv(f"{out}/predictions")
    truth = {"home": "Domestic Violence", "vote": "Politics", "stayed": "Victim/Survivor"}
    got = rows(predicted, "id", "hashtags", "prediction", "url")
    assert len(got) == 120 - earlier
    assert all(prediction == truth[tag] and url == f"u{i}" for i, tag, prediction, url in got)


def test_scratch_is_removed_after_a_failure(spark):
    before = set(Path(runtime.shared_folder(spark).removeprefix("file:")).glob("postlens/job-*"))
    with pytest.raises(ZeroDivisionError), runtime.job_scratch(spark):
        runtime.stage(spark.range(3), "numbers")
        assert set(Path(runtime.shared_folder(spark).removeprefix("file:")).glob("postlens/job-*")) - before
        raise ZeroDivisionError
    assert set(Path(runtime.shared_folder(spark).removeprefix("file:")).glob("postlens/job-*")) == before


def test_foreign_files_with_rejects(spark, tmp_path):
    lexicon = spark.createDataFrame([("good", 0.7, 0.6, 1.0)], LEXICON)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(
        ",id,date,username,display_name,content,reply_count,retweet_count,like_count,quote_count,mentioned_users,hashtags\n"
        "0,1,2021-03-04,me,Me,good day,1,2,3,4,,\n1,2,yesterday,me,Me,x,1,2,3,4,,\n"
    )
    with pytest.raises(Exception, match="unreadable row"):
        jobs.process_files(spark, f"{tmp_path}/in", lexicon, f"{tmp_path}/bad", foreign=True)
    jobs.process_files(spark, f"{tmp_path}/in", lexicon, f"{tmp_path}/out", foreign=True, rejects=f"{tmp_path}/rejects")
    assert rows(files.read_family(spark, f"{tmp_path}/out", "posts"), "id", "month") == [(1, datetime.date(2021, 3, 1))]
    assert rows(spark.read.parquet(f"{tmp_path}/rejects"), "id", "date") == [("2", "yesterday")]
