import pytest
from pyspark.sql import functions as F

from postlens.functions import scalars
from postlens.operators import sampling
from postlens.plans import model_runs
from tests.conftest import rows


@pytest.fixture(scope="module")
def labelled(spark):
    category = F.when(F.col("id") % 10 < 6, "Big").when(F.col("id") % 10 < 9, "Mid").otherwise("Victim/Survivor")
    return spark.range(2000).select("id", category.alias("category")).cache()


@pytest.mark.parametrize("levels", [1, 2])
def test_histograms_and_ranking_agree(spark, labelled, levels):
    keyed = labelled.withColumn("key", scalars.unit_hash("x", F.col("id")))
    # many equal keys, too
    for key in (F.col("key"), F.floor(F.col("key") * 20) / 20, F.lit(1.0)):
        frame = keyed.withColumn("key", key)
        quotas = spark.createDataFrame([("Big", 700), ("Mid", 1), ("Victim/Survivor", 200)], "category string, quota long")
        columns = ["category", "_cut_key", "_cut_tie"]
        expected = sampling.cut_points(frame, quotas, ["category"], "key", "id", 0)
        got = sampling.cut_points(frame, quotas, ["category"], "key", "id", levels)
        assert rows(got, *columns) == rows(expected, *columns)
        assert frame.join(got, "category").filter(sampling.within("key", "id")).count() == 901


def test_early_limits_leave_enough(labelled):
    keyed = labelled.select(sampling.draw_key("s", F.col("id"), F.lit(3.0)).alias("key"))
    for wanted in (0, 10, 700):
        limit = sampling.key_limit([(3.0, 2000)], wanted)
        assert wanted <= keyed.filter(F.col("key") <= limit).count() <= wanted + 600
    assert sampling.key_limit([(1.0, 50)], 40) == float("inf")


def test_levels():
    assert sampling.levels_for(10) == 0
    assert sampling.levels_for(1_000_000) == 1
    assert sampling.levels_for(10**11) == 3


def test_uniform(labelled):
    sample = sampling.sample_uniform(labelled, 500, "seed")
    assert sample.count() == sample.select("id").distinct().count() == 500
    assert rows(sample, "id") == rows(sampling.sample_uniform(labelled, 0.25, "seed"), "id")
    assert rows(sample, "id") != rows(sampling.sample_uniform(labelled, 500, "other"), "id")
    # larger samples contain smaller ones of the same seed
    assert set(rows(sampling.sample_uniform(labelled, 100, "seed"), "id")) < set(rows(sample, "id"))


def test_weighted_favours_rare_classes(labelled):
    sample = sampling.sample_weighted(labelled, 400, "seed")
    assert sample.count() == 400
    share = {r["category"]: r["count"] / 400 for r in sample.groupBy("category").count().collect()}
    assert share["Big"] < 0.5 and share["Victim/Survivor"] > 0.12


def test_too_large_samples_are_refused(labelled):
    with pytest.raises(ValueError, match="without replacement"):
        sampling.sample_uniform(labelled, 2001, "s")
    # with a single class no row has a weight
    with pytest.raises(ValueError):
        sampling.sample_weighted(labelled.withColumn("category", F.lit("x")), 1, "s")


def test_split(labelled):
    split = sampling.stratified_split(labelled, "seed")
    assert split.count() == 2000 and split.select("id").distinct().count() == 2000
    assert rows(split.filter("is_test").groupBy("category").count(), "category", "count") == [
        ("Big", 240), ("Mid", 120), ("Victim/Survivor", 40),
    ]


def test_split_keeps_tiny_classes_in_training(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b")], "id long, category string")
    assert rows(sampling.stratified_split(frame, "s").filter("is_test"), "category") == [("b",)]


def test_class_counts(labelled):
    got = sampling.class_counts(labelled, ["category"]).select("category", "class_count").distinct()
    assert rows(got, "category", "class_count") == [("Big", 1200), ("Mid", 600), ("Victim/Survivor", 200)]


@pytest.mark.parametrize("method", range(5))
def test_methods(labelled, method):
    sample = model_runs.apply_method(labelled, method, 300)
    assert sample.count() == 300
    classes = {r[0] for r in rows(sample.select("category").distinct(), "category")}
    assert classes == ({"Big", "Mid", "Victim/Survivor"} if method < 2 else {"Other", "Victim/Survivor"})


def test_weights_follow_the_order_of_the_steps(labelled):
    def survivors(method):
        return model_runs.apply_method(labelled, method, 300).filter("category = 'Victim/Survivor'").count()

    # 200 survivors among 2000: drawn evenly, by three classes, by two classes
    assert survivors(2) < survivors(3) < survivors(4)


def test_runs_of_a_grid_are_drawn_like_single_ones(labelled):
    runs = [model_runs.Run(i, m, n, f"s{i}") for i, (m, n) in enumerate([(0, 100), (1, 150), (4, 0.1)])]
    together = model_runs.draw(labelled, runs)
    for run in runs:
        alone = model_runs.draw(labelled, [run])
        assert rows(together.filter(F.col("run") == run.run), "id", "category") == rows(alone, "id", "category")
