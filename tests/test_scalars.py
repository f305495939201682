import datetime

from pyspark.sql import functions as F

from postlens.functions import scalars


def test_dates(spark):
    frame = spark.sql("select timestamp '2021-02-28 23:59:59' as t")
    got = frame.select(scalars.day(F.col("t")), scalars.month_start(F.col("t"))).first()
    assert tuple(got) == (datetime.date(2021, 2, 28), datetime.date(2021, 2, 1))


def test_rounding_works_on_the_binary_value(spark):
    frame = spark.createDataFrame([(0.575,), (0.125,), (0.375,), (-0.125,), (0.005,)], "x double")
    got = [r[0] for r in frame.select(scalars.round_half_even(F.col("x"))).collect()]
    assert got == [0.57, 0.12, 0.38, -0.12, 0.0]


def test_neutral_is_positive(spark):
    frame = spark.createDataFrame([(-0.1,), (0.0,), (0.1,)], "x double")
    got = [r[0] for r in frame.select(scalars.polarity_label(F.col("x"))).collect()]
    assert got == ["Negative", "Positive", "Positive"]


def test_outcomes(spark):
    frame = spark.createDataFrame([("T", "T"), ("A", "T"), ("T", "A"), ("A", "A"), ("A", "B")], "a string, p string")
    check = scalars.outcome_check(F.col("a"), F.col("p"), "T")
    got = [r[0] for r in frame.select(check).collect()]
    # a wrong guess between two other classes is a false negative, too
    assert got == ["True-Positive", "False-Positive", "False-Negative", "True-Negative", "False-Negative"]


def test_hash_is_in_the_open_unit_interval(spark):
    got = spark.range(5000).select(scalars.unit_hash("s", F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < got[0] and got[1] < 1 and abs(got[2] - 0.5) < 0.02
