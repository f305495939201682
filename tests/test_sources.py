"""Captures, file round trips, reports and the inbox."""

import datetime

import pytest
from pyspark.sql import functions as F

from postlens.functions import scalars
from postlens.plans.enrich import process_raw
from postlens.schemas import FAMILIES, HASHTAG_CLASSES, LEXICON, RAW_POSTS
from postlens.sources import capture, files
from postlens.streaming import inbox
from tests.conftest import rows

DAY = datetime.datetime(2021, 3, 5, 8, 0)


def post(key, content, day=DAY, users=None, tags=None):
    return (key, day, "me", "Me, \"too\"", content, 1, 2, 3, 4, users, tags)


TRICKY = [
    post(1, 'quotes "inside", commas\nand line breaks'),
    post(2, "  blanks kept  ", users="[User(username='a', id=1, displayname='A', description=None)]", tags="['X']"),
    post(3, "back\\slash and 'single'"),
    post(4, "good"),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("good", 0.5, 0.5, 1.0)], LEXICON)


def test_raw_round_trip(spark, tmp_path):
    raw = spark.createDataFrame(TRICKY, RAW_POSTS)
    files.write_raw(raw, f"{tmp_path}/raw")
    assert rows(files.read_raw(spark, f"{tmp_path}/raw"), *raw.columns) == rows(raw, *raw.columns)


def test_other_files_are_ignored(spark, tmp_path):
    raw = spark.createDataFrame(TRICKY, RAW_POSTS)
    files.write_raw(raw, f"{tmp_path}/raw")
    (tmp_path / "raw" / "notes.txt").write_text("1,2,3\n")
    assert files.read_raw(spark, f"{tmp_path}/raw").count() == 4


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    b = spark.createDataFrame([("y", 2)], "name string, id long")
    c = spark.createDataFrame([(3,)], "id long")
    assert rows(files.union_by_name([a, b, c]), "id", "name") == [(1, "x"), (2, "y"), (3, None)]


def test_families_are_stored_and_combined(spark, tmp_path, lexicon):
    raw = spark.createDataFrame(TRICKY, RAW_POSTS)
    for name, part in (("a", raw.filter("id < 3")), ("b", raw.filter("id >= 3"))):
        files.write_families(process_raw(part, lexicon, staged=True), f"{tmp_path}/{name}")
    whole = process_raw(raw, lexicon)
    for name, schema in FAMILIES.items():
        stored = files.union_files(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], name)
        assert rows(stored, *schema.fieldNames()) == rows(whole[name], *schema.fieldNames()), name
    tables = files.load_text_tables(spark, f"{tmp_path}/a")
    assert rows(tables["posts"], "id", "hashtags", "mentioned_usernames") == [(1, "", ""), (2, "x", "a")]


def test_one_month_is_read_alone(spark, tmp_path, lexicon):
    raw = spark.createDataFrame(TRICKY, RAW_POSTS)
    files.write_families(process_raw(raw, lexicon, staged=True), f"{tmp_path}/f")
    march = files.read_family(spark, f"{tmp_path}/f", "posts").filter(F.col("month") == datetime.date(2021, 3, 1))
    assert "PartitionFilters: [isnotnull(month" in march._jdf.queryExecution().executedPlan().toString()


def test_class_table(spark, tmp_path):
    path = tmp_path / "classes.csv"
    path.write_text("row,phrase,count,survivor,domestic_violence,politics,health\n1,metoo,5,1,0,0,0\n2,vote,,0,0,1,0\n")
    table = files.read_class_table(spark, str(path), HASHTAG_CLASSES)
    assert rows(table, "phrase", "count", "politics") == [("metoo", 5, 0), ("vote", None, 1)]


def test_report(spark, tmp_path, lexicon):
    families = process_raw(spark.createDataFrame(TRICKY, RAW_POSTS), lexicon)
    topics = families["posts"].withColumn("topic", F.lit(1))
    report = files.report_tables(topics, families["hashtag_lists"], families["mention_lists"])
    assert report["posts"].columns == [
        "id", "date", "username", "display_name", "content", "reply_count", "retweet_count", "like_count",
        "quote_count", "sentiment", "polarity", "subjectivity", "topic",
    ]
    files.write_report(report, f"{tmp_path}/report")
    back = spark.read.options(**files.CSV_OPTIONS).csv(f"{tmp_path}/report/mentions")
    assert rows(back, "id", "username", "display_name") == [("2", "a", "A")]


@pytest.fixture(scope="module")
def archive(spark):
    def at(*when):
        return datetime.datetime(*when)

    listed = [
        (1, at(2021, 1, 31, 23, 59), "en", "The Word"),
        (2, at(2021, 2, 1), "en", "the word"),
        (3, at(2021, 2, 28, 12), "fr", "the word"),
        (4, at(2021, 3, 31, 23, 59), "en", "a WORD"),
        (5, at(2021, 4, 1), "en", "word"),
        (6, at(2021, 3, 1), "en", "other"),
        (7, at(2021, 3, 10, 1), "en", "word"),
    ]
    frame = spark.createDataFrame([post(i, c, d) for i, d, _, c in listed], RAW_POSTS)
    languages = spark.createDataFrame([(i, lang, f"u{i}") for i, _, lang, _ in listed], "id long, lang string, url string")
    return frame.join(languages, "id")


def test_monthly_capture(archive):
    feb, mar, apr = (datetime.date(2021, m, 1) for m in (2, 3, 4))
    got = capture.capture_monthly(archive, "Word", feb, datetime.date(2021, 3, 9))
    # the last window is a whole month
    assert rows(got, "id", "window_start", "window_end") == [(2, feb, mar), (4, mar, apr), (7, mar, apr)]
    clipped = capture.capture_monthly(archive, "Word", feb, datetime.date(2021, 3, 10), clip_to_end=True)
    assert rows(clipped, "id", "window_end") == [(2, mar), (7, datetime.date(2021, 3, 11))]
    december = capture.capture_monthly(archive, "word", feb, datetime.date(2021, 12, 1))
    assert rows(december, "id") == [(2,), (4,), (5,), (7,)]
    with pytest.raises(ValueError):
        capture.capture_monthly(archive, "word", datetime.date(2021, 1, 31), mar)


def test_capture_files(spark, archive, tmp_path):
    feb = datetime.date(2021, 2, 1)
    captured = capture.capture_monthly(archive, "word", feb, datetime.date(2021, 3, 9))
    capture.write_capture(captured, f"{tmp_path}/c")
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if p.is_dir()) == [
        "window_start=2021-02-01", "window_start=2021-03-01",
    ]


def test_window_capture(archive):
    got = capture.capture_window(archive, "word", datetime.date(2021, 3, 1), datetime.date(2021, 4, 1))
    assert rows(got, "id", "url") == [(4, "u4"), (7, "u7")]


def test_inbox(spark, tmp_path, lexicon):
    raw = spark.createDataFrame(TRICKY, RAW_POSTS)
    box, out = f"{tmp_path}/inbox", f"{tmp_path}/out"

    def run(**options):
        query = inbox.ingest_inbox(spark, box, lexicon, out, f"{tmp_path}/checkpoint", **options)
        query.awaitTermination()

    files.write_raw(raw.filter("id < 3").repartition(2), box)
    run(max_files=1)
    files.write_raw(raw.filter("id >= 3"), box, mode="append")
    run(archive=f"{tmp_path}/archive")
    run()  # nothing new
    whole = process_raw(raw, lexicon)
    for name, schema in FAMILIES.items():
        assert rows(inbox.processed(spark, out, name), *schema.fieldNames()) == rows(
            whole[name], *schema.fieldNames()
        ), name


HEADER = ",id,date,username,display_name,content,reply_count,retweet_count,like_count,quote_count,mentioned_users,hashtags\n"
GOOD = ["0,1,2021-03-04 23:30:00+00:00,a,A,x,1,2,3,4,,", "1,2,2021-03-04,a,A,x,1,2,3,4,,", r"""2,3,2021-03-04 01:00:00+02:00,a,A,x,,,,,,"['ok', 'a\xa0b']" """.strip()]
BAD = ["3,4,04.03.2021,a,A,x,1,2,3,4,,", "4,5,2021-03-04,a,A,x,many,2,3,4,,", "5,,2021-03-04,a,A,x,1,2,3,4,,", "6,6,2021-03-04,a,A,x,1,2,3,4,,['torn", "7,7,2021-03-04,a,A"]


def test_unreadable_rows_are_never_lost(spark, tmp_path):
    (tmp_path / "good.csv").write_text(HEADER + "\n".join(GOOD))
    read = files.read_raw(spark, str(tmp_path))
    days = read.select("id", F.date_format("date", "MM-dd HH").alias("d"))
    assert rows(days, "id", "d") == [(1, "03-04 23"), (2, "03-04 00"), (3, "03-03 23")]
    (tmp_path / "more.csv").write_text(HEADER + "\n".join(BAD))
    with pytest.raises(Exception, match="unreadable row"):
        files.read_raw(spark, str(tmp_path)).count()
    assert files.read_raw(spark, str(tmp_path), rejects=f"{tmp_path}/rejects").count() == 3
    refused = spark.read.parquet(f"{tmp_path}/rejects")
    assert refused.count() == 5 and rows(refused.select("id").distinct(), "id") == [("4",), ("5",), ("6",), ("7",), (None,)]


def test_batches_of_the_inbox_make_no_difference(spark, tmp_path, lexicon):
    posts = [post(7, "good one", users="[User(username='a', id=1, displayname='A', description=None)]", tags="['X']"), post(8, "other")]
    found = []
    for name, options in (("one", {"max_files": 1}), ("all", {})):
        box = f"{tmp_path}/{name}"
        frame = spark.createDataFrame(posts, RAW_POSTS).coalesce(1)
        files.write_raw(frame, box)
        files.write_raw(frame, f"{box}/sub/folder")
        inbox.ingest_inbox(spark, box, lexicon, f"{box}-out", f"{box}-check", **options).awaitTermination()
        found.append(rows(inbox.processed(spark, f"{box}-out", "posts"), "id", "content", "mentioned_usernames"))
    batch = process_raw(files.read_raw(spark, f"{tmp_path}/all"), lexicon)["posts"]
    found.append(rows(batch, "id", "content", "mentioned_usernames"))
    assert found[0] == found[1] == found[2] and len(found[0]) == 4


def test_inbox_rejects(spark, tmp_path, lexicon):
    (tmp_path / "box").mkdir()
    (tmp_path / "box" / "a.csv").write_text(HEADER + "\n".join(GOOD + BAD))
    inbox.ingest_inbox(spark, f"{tmp_path}/box", lexicon, f"{tmp_path}/out", f"{tmp_path}/check", rejects=f"{tmp_path}/no").awaitTermination()
    assert inbox.processed(spark, f"{tmp_path}/out", "posts").count() == 3
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/no").count() == 5


def test_days_are_those_of_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        frame = spark.sql("select to_timestamp('2022-01-01 02:00:00+00:00') as ts")
        assert rows(frame.select(scalars.month_start(F.col("ts")).alias("m")), "m") == [(datetime.date(2022, 1, 1),)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_many_keywords_in_one_scan(spark, archive):
    feb, last = datetime.date(2021, 2, 1), datetime.date(2021, 4, 9)
    odd = spark.createDataFrame([post(i, c, datetime.datetime(2021, 2, 3, 12)) for i, c in ((20, "ÀÉ straße \U0001f600\U0001f601 wörd"), (21, None), (22, ""))], RAW_POSTS)
    more = archive.unionByName(odd.withColumn("lang", F.lit("en")).withColumn("url", F.lit("u")))
    words = ["Word", "the", "THE w", "o", "other", "nothing at all", "Éé", "àé str", "\U0001f600\U0001f601", "wörd", "the"]
    columns = ["id", "capture", "window_start", "window_end"]
    single = sorted((w, *r) for w in dict.fromkeys(words) for r in rows(capture.capture_monthly(more, w, feb, last), *columns))
    assert len(single) > 10
    for source in (more, capture.with_signature(more), capture.with_signature(more, 1)):
        longs = 1 if source.columns == more.columns else len(source.select("signature").first()[0])
        found = capture.capture_keywords(source, words, feb, last, longs=longs)
        assert rows(found, "keyword", *columns) == single
    with pytest.raises(ValueError, match="no keyword"):
        capture.capture_keywords(more, [], feb, last)
    assert rows(capture.capture_monthly(more, "word", feb, last), "id") == rows(capture.capture_keywords(more, ["word"], feb, last), "id")


def test_keywords_read_the_archive_once(spark, archive, tmp_path):
    capture.with_signature(archive).write.parquet(f"{tmp_path}/signed")
    signed = spark.read.parquet(f"{tmp_path}/signed")
    plan = capture.capture_keywords(signed, [f"word {i}" for i in range(50)], datetime.date(2021, 2, 1), datetime.date(2021, 3, 1))
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_a_signature_holds_the_bits_of_every_keyword_inside(spark):
    content = "The quick brown Fox Ünter den Linden, İ ok"
    bits = capture.with_signature(spark.createDataFrame([(content,)], "content string")).first()["signature"]
    for start in range(0, 36, 3):
        for size in (1, 2, 3, 7):
            word = content[start : start + size]
            assert all(b & k == k for b, k in zip(bits, capture.trigram_slots(word), strict=True)), word
    assert any(b & k != k for b, k in zip(bits, capture.trigram_slots("zzzzq"), strict=True))
