import datetime

import pytest
from pyspark.sql import functions as F

from postlens.operators import ngrams
from tests.conftest import rows

JAN, FEB, NEXT = datetime.date(2021, 1, 1), datetime.date(2021, 2, 1), datetime.date(2022, 1, 1)


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(
        [(JAN, "red fox red fox"), (JAN, "red fox"), (FEB, "red fox"), (FEB, ""), (NEXT, "red red red")],
        "month date, content string",
    )


def test_counts_above_one(posts):
    assert rows(ngrams.ngram_counts(posts, "content", 1), "phrase", "count") == [("fox", 4), ("red", 7)]
    assert rows(ngrams.ngram_counts(posts, "content", 2), "phrase", "count") == [("red fox", 4), ("red red", 2)]
    assert rows(ngrams.ngram_counts(posts, "content", 3), "phrase", "count") == []
    assert rows(ngrams.ngram_counts(posts, "content", 3, min_count=1), "phrase", "count") == [
        ("fox red fox", 1), ("red fox red", 1), ("red red red", 1),
    ]


def test_monthly(spark, posts):
    tags = spark.createDataFrame(
        [(JAN, "aa bb"), (JAN, "aa"), (datetime.date(2020, 12, 1), "aa aa"), (NEXT, "aa aa")], "month date, hashtags string"
    )
    names = spark.createDataFrame([(FEB, "ann ann"), (FEB, None)], "month date, username string")
    monthly = ngrams.monthly_ngrams(posts, tags, names)
    # neither the excluded year nor months without posts appear
    assert rows(monthly, "category", "ngram_type", "month", "phrase", "count") == [
        ("hashtag", "unigram", JAN, "aa", 2),
        ("mention", "unigram", FEB, "ann", 2),
        ("tweet", "bigram", JAN, "red fox", 3),
        ("tweet", "unigram", JAN, "fox", 3),
        ("tweet", "unigram", JAN, "red", 3),
    ]
    assert rows(ngrams.collated_ngrams(monthly).filter("category = 'Tweet'"), "ngram_type", "phrase") == [
        ("Bigrams", "red fox"), ("Unigrams", "fox"), ("Unigrams", "red"),
    ]


def test_top_words(spark, posts):
    drop = spark.createDataFrame([("fox",)], "phrase string")
    top = ngrams.top_words(posts, "content", 1, top=1, exclusions=drop)
    assert rows(top, "phrase", "count") == [("red", 7)]
    assert rows(ngrams.top_words(posts, "content", 2, containing="x r"), "phrase") == [("fox red",)]
    assert [r["phrase"] for r in ngrams.top_words(posts, "content", 1).collect()] == ["red", "fox"]


def test_top_words_by_month(posts):
    top = ngrams.top_words_by(posts, "content", "month", 1, top=1)
    # equal counts in alphabetical order
    assert rows(top, "month", "phrase", "count") == [(JAN, "fox", 3), (FEB, "fox", 1), (NEXT, "red", 3)]


def test_no_terms_at_all(spark):
    empty = spark.createDataFrame([(JAN, "")], "month date, content string")
    assert rows(ngrams.ngram_counts(empty, "content", 1, 1), "phrase", "count") == []


def test_terms_are_cut_out_once_per_post(posts):
    plan = ngrams.ngram_counts(posts, "content", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("slots", [ngrams.SLOTS, 3], ids=["few shared slots", "all shared"])
def test_levels_give_the_same_rows(spark, posts, slots):
    import random

    rng = random.Random(7)
    listed = [(rng.choice([JAN, FEB, None]), " ".join(rng.choices(["red", "fox", "Den", "a", "hill", "oak"], k=rng.randint(0, 9)))) for _ in range(60)]
    more = posts.unionByName(spark.createDataFrame([*listed, (JAN, None)], "month date, content string"))
    tags, names = (more.withColumnRenamed("content", c) for c in ("hashtags", "username"))
    columns = ["category", "ngram_type", "month", "phrase", "count"]
    for least in (2, 5):
        whole = rows(ngrams.monthly_ngrams(more, tags, names, min_count=least), *columns)
        assert rows(ngrams.monthly_ngrams_by_levels(more, tags, names, min_count=least, slots=slots), *columns) == whole
    assert ngrams.monthly_ngrams_by_levels(more.limit(0), tags, names).count() == 0


def test_levels_shuffle_fewer_phrases(spark):
    # every pair of words but one is found once, so hardly any phrase of three words goes on
    unique = [(JAN, f"w{i} w{i + 1}x common pair w{i}y") for i in range(50)]
    text = spark.createDataFrame(unique, "month date, content string").selectExpr("'tweet' as category", "month", "split(content, ' ') as terms")
    words = ngrams._passing(text, 1, None, 64 * 1024)
    again = words.groupBy("category", "month", "phrase").count().where("count > 1")
    slots = again.select(ngrams._slot(*(F.col(c) for c in ("category", "month", "phrase")), 64 * 1024).alias("slot"))
    passing = ngrams._passing(text, 2, slots, 64 * 1024)
    assert ngrams._passing(text, 2, None, 64 * 1024).count() == 200 and 50 <= passing.count() < 60


@pytest.mark.parametrize("kept", [20_000, 40, 3], ids=["all kept", "some lost", "bound fails"])
def test_summaries_give_the_same_rows(spark, kept):
    import random

    rng = random.Random(9)
    words = [f"w{i}x" for i in range(300)]
    listed = [" ".join(rng.choices(words, weights=[1 / (i + 1) ** 2 for i in range(300)], k=rng.randint(0, 20))) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in [*listed, None, ""]], "content string").repartition(3)
    out = spark.createDataFrame([("w0x",), ("w3x",), ("w0x",)], "phrase string")
    for options in ({"top": 5}, {"top": 4, "exclusions": out}, {"top": 3, "containing": "2"}, {"n": 2, "top": 3}, {"top": 10_000}, {"containing": "no such"}):
        whole = [tuple(r) for r in ngrams.top_words(frame, "content", **options).collect()]
        assert [tuple(r) for r in ngrams.top_words_by_summaries(frame, "content", kept=kept, **options).collect()] == whole
    assert ngrams.top_words_by_summaries(frame.limit(0), "content").count() == 0


def test_summaries_pass_on_candidates_only(spark):
    frame = spark.createDataFrame([("often " * 50 + " ".join(f"one{i}x{j}" for j in range(40)),) for i in range(30)], "content string").repartition(2)
    found = ngrams.top_words_by_summaries(frame, "content", top=1, kept=100)
    assert [tuple(r) for r in found.collect()] == [("often", 1500)]
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_count_before_the_shuffle(spark):
    # phrases longer than a run of terms apart, repeats across runs, rows and keys; counted a few runs at a time
    listed = [(JAN, "ab cd " * 400), (FEB, "ab cd " * 3), (None, "ab cd"), (JAN, "é_1 ab cd"), (FEB, ""), (FEB, None), (JAN, "x")]
    frame = spark.createDataFrame(listed, "month date, content string").repartition(2)
    for n in (1, 2, 3, 5):
        whole = ngrams.phrases(frame, "content", ["month"], {"n": n}).groupBy("month", "phrase").count()
        for held in (None, 10):
            counted = ngrams.phrase_counts(ngrams.term_runs(frame, "content", ["month"], n), ["month"], {"n": n}, held=held)
            assert rows(counted, "month", "phrase", "count") == rows(whole, "month", "phrase", "count")
    packed = ngrams.packed_counts(ngrams.term_runs(frame.limit(1), "content", [], 2), [], {"n": 2}, ngrams.to_arrow_schema(counted.select("phrase", "count").schema), 1000, ngrams.Tally.starts)
    assert packed.count() <= 2  # 799 phrases, two of them different


def test_lengths_are_counted_in_one_reading(posts):
    together = ngrams.ngram_counts(posts, "content", (1, 2, 3), min_count=1)
    apart = [(*r, n) for n in (1, 2, 3) for r in rows(ngrams.ngram_counts(posts, "content", n, min_count=1), "phrase", "count")]
    assert rows(together, "phrase", "count", "n") == sorted(apart)
    assert together._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_numbers_of_phrases_do_not_overflow(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"terms": [["a", "b", "c", "a", "b", "c"], ["b", "c", "a"]], "key": ["x", "y"]})
    tally = ngrams.Tally([batch], ["key"])
    found = [tally.count(3, tally.starts(3), limit) for limit in (1 << 62, 4, 1)]
    listed = [sorted(zip(tally.keys[0].take(pa.array(g)).to_pylist(), tally.phrases(t).to_pylist(), c.tolist(), strict=True)) for g, t, c in found]
    assert listed[0] == listed[1] == listed[2] == [("x", "a b c", 2), ("x", "b c a", 1), ("x", "c a b", 1), ("y", "b c a", 1)]


def test_months_phrases_are_not_shuffled_one_by_one(posts):
    monthly = ngrams.monthly_ngrams(posts, posts.withColumnRenamed("content", "hashtags"), posts.withColumnRenamed("content", "username"))
    levels = ngrams.term_runs(posts, "content", ["month"], 3)
    for frame in (monthly, ngrams.collated_ngrams(monthly), ngrams.ngram_counts(posts, "content", 2), ngrams.phrase_counts(levels, ["month"], {"n": 2})):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 2 and "packed" in plan


def test_levels_pass_bits(spark, posts):
    # of a phrase whose parts repeat in another month only, nothing is counted
    counts = spark.createDataFrame([(JAN, "red"), (JAN, "fox"), (FEB, "red")], "month date, phrase string")
    bits = ngrams._bits(counts, ["month"], 1, 1 << 16)
    assert sum(int(b).bit_count() for b in bits if b >= 0) + sum(64 - (~int(b)).bit_count() for b in bits if b < 0) == 3
    runs = ngrams.term_runs(posts, "content", ["month"], 3)
    counted = ngrams.phrase_counts(runs, ["month"], {"n": 2}, passing=ngrams._both_parts(bits, 1 << 16))
    assert rows(counted, "month", "phrase", "count") == [(JAN, "fox red", 1), (JAN, "red fox", 3)]
