"""TF-IDF and neighbours against a plain computation on small fixtures."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlens import runtime
from postlens.operators import features, knn, postings
from tests.conftest import rows

BLOCKS = features.BLOCKS
COLUMNS = "run int, id long, contents string, mentions string, hashtags string, sentiment double, subjectivity double"


def make(rng, key, run=0, alphabet="abcdefgh"):
    def text(n):
        return " ".join(rng.choice(alphabet) * 2 for _ in range(rng.randint(0, n)))

    return (run, key, text(8), text(2), text(3), rng.randint(-20, 20) / 100, rng.randint(0, 20) / 100)


def fixture(seed=3, n_train=60, n_query=25):
    rng = random.Random(seed)
    train = [make(rng, i) for i in range(n_train)]
    train[7] = (0, 7) + train[3][2:]  # exact copies: equal distances
    train[9] = (0, 9) + train[3][2:]
    train[11] = (0, 11, "", "", "", 0.0, 0.0)
    labels = [rng.choice(["A", "B", "C"]) for _ in train]
    query = [make(rng, 1000 + i) for i in range(n_query)]
    query[0] = (0, 1000, "zz yy", "", "", 0.0, 0.0)  # no known term
    query[1] = (0, 1001, "", "", "", 0.1, 0.1)
    query[2] = (0, 1002) + train[3][2:]
    return [t + (c,) for t, c in zip(train, labels)], query


def tokens(value):
    return re.findall(r"\w\w+", value.lower())


def plain_weights(train, row_list):
    n = len(train)
    idf = {}
    for b, name in enumerate(BLOCKS):
        df = Counter(t for row in train for t in set(tokens(row[2 + b])))
        idf[name] = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    out = {}
    for row in row_list:
        blocks = {}
        for b, name in enumerate(BLOCKS):
            raw = {t: c * idf[name][t] for t, c in Counter(tokens(row[2 + b])).items() if t in idf[name]}
            length = math.sqrt(sum(w * w for w in raw.values()))
            blocks[name] = {t: w / length for t, w in raw.items()}
        out[row[1]] = blocks
    return out


def plain_neighbours(train, query, k):
    tw, qw = plain_weights(train, train), plain_weights(train, query)
    out = {}
    for q in query:
        found = []
        for t in train:
            d = (q[5] - t[5]) ** 2 + (q[6] - t[6]) ** 2
            for b in BLOCKS:
                x, y = qw[q[1]][b], tw[t[1]][b]
                d += sum((x.get(w, 0) - y.get(w, 0)) ** 2 for w in x.keys() | y.keys())
            found.append((round(d, 9) + 0.0, t[1], t[7]))
        out[q[1]] = sorted(found)[:k]
    return out


def plain_votes(nearest):
    counts = Counter(c for _, _, c in nearest)
    return min(counts, key=lambda c: (-counts[c], c))


def frames(spark, train, query):
    return (
        spark.createDataFrame(train, COLUMNS + ", category string"),
        spark.createDataFrame(query, COLUMNS),
    )


@pytest.mark.parametrize("limit", [None, -1], ids=["broadcast", "salted"])
def test_weights(spark, limit):
    train, query = fixture()
    t, q = frames(spark, train, query)
    model = features.fit(t)
    for frame, source in ((t, train), (q, query)):
        expected = plain_weights(train, source)
        got = {}
        for key, block, token, weight, blocks in rows(
            model.transform(frame, broadcast_limit=limit), "id", "block", "token", "weight", "blocks"
        ):
            got.setdefault(key, {b: {} for b in BLOCKS})[block][token] = weight
            assert blocks == sum(1 for b in BLOCKS if expected[key][b])
        for key, blocks in expected.items():
            for b in BLOCKS:
                assert got.get(key, {}).get(b, {}) == pytest.approx(blocks[b])


def test_blank_rows_count_as_documents(spark):
    t = spark.createDataFrame([(0, 1, "aa", "", "", 0.0, 0.0), (0, 2, "", "", "", 0.0, 0.0)], COLUMNS)
    assert rows(features.fit(t).idf, "token", "df", "idf") == [("aa", 1, pytest.approx(math.log(3 / 2) + 1))]


def test_assembled_features(spark):
    t = spark.createDataFrame([(0, 1, "aa", "bb", "", 0.5, 0.25)], COLUMNS)
    table = features.assemble_features(features.fit(t).transform(t), t)
    assert rows(table, "block", "token", "weight") == [
        ("contents", "aa", 1.0), ("mentions", "bb", 1.0), ("sentiment", "", 0.5), ("subjectivity", "", 0.25),
    ]


@pytest.mark.parametrize("limit", [None, -1], ids=["broadcast", "shuffled"])
def test_partitions_follow_the_size_of_the_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(features, "TASK_BYTES", 100)
    t = spark.createDataFrame([(0, i, "aa bb " * 40, "cc", None, 0.5, 0.25) for i in range(50)], COLUMNS)
    assert features.text_partitions(t) == 50 * 242 // 100
    weights = features.fit(t).transform(t, broadcast_limit=limit)
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    # by a number, so that Spark does not merge them
    assert re.search(r"RepartitionByExpression \[id#\d+L?\], 121", plan)
    assert weights.count() == 150


@pytest.mark.parametrize("limit", [None, -1], ids=["broadcast", "salted"])
def test_neighbours(spark, limit):
    train, query = fixture()
    t, q = frames(spark, train, query)
    k = 7
    expected = plain_neighbours(train, query, k)
    got = {}
    for key, rank, train_id, distance, category in rows(
        knn.neighbours(t, q, k, limit), "id", "rank", "train_id", "distance2", "category"
    ):
        got.setdefault(key, []).append((distance, train_id, category))
    assert got.keys() == expected.keys()
    for key in expected:
        assert [x[1:] for x in got[key]] == [x[1:] for x in expected[key]], key
        assert [x[0] for x in got[key]] == pytest.approx([x[0] for x in expected[key]], abs=2e-9)


def test_few_shared_terms(spark):
    # a large alphabet: most pairs share nothing, so scores and blocks decide
    rng = random.Random(5)
    alphabet = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x430, 0x450)]
    train = [make(rng, i, alphabet=alphabet) + (rng.choice("AB"),) for i in range(80)]
    query = [make(rng, 500 + i, alphabet=alphabet) for i in range(40)]
    t, q = frames(spark, train, query)
    expected = plain_neighbours(train, query, 5)
    got = {}
    for key, _, train_id in rows(knn.neighbours(t, q, 5), "id", "rank", "train_id"):
        got.setdefault(key, []).append(train_id)
    assert got == {key: [x[1] for x in found] for key, found in expected.items()}


def test_predictions_for_several_k(spark):
    train, query = fixture(seed=8)
    t, q = frames(spark, train, query)
    got = {(key, k): p for key, k, p in rows(knn.classify(t, q, [1, 3, 6]), "id", "k", "prediction")}
    for k in (1, 3, 6):
        for key, found in plain_neighbours(train, query, k).items():
            assert got[key, k] == plain_votes(found)


def test_runs_do_not_mix(spark):
    first, query = fixture(seed=1, n_train=30, n_query=10)
    second, _ = fixture(seed=2, n_train=40, n_query=10)
    both_train = first + [(1,) + row[1:] for row in second]
    both_query = query + [(1,) + row[1:] for row in query]
    t, q = frames(spark, both_train, both_query)
    got = {}
    for run, key, _, train_id in rows(knn.neighbours(t, q, 4), "run", "id", "rank", "train_id"):
        got.setdefault((run, key), []).append(train_id)
    for run, train in ((0, first), (1, second)):
        for key, found in plain_neighbours(train, query, 4).items():
            assert got[run, key] == [x[1] for x in found]


def test_too_few_training_rows(spark):
    train, query = fixture(n_train=20)
    t, q = frames(spark, train[:5], query)
    with pytest.raises(ValueError, match="neighbours"):
        knn.neighbours(t, q, 7)


def test_queries_are_moved_once(spark):
    train, query = fixture()
    t, q = frames(spark, train, query)
    plan = knn.neighbours(t, q, 7)._jdf.queryExecution().executedPlan().toString()
    # the texts and the scores go to their partitions; nothing keyed by pair is shuffled
    assert plan.count("REPARTITION_BY_NUM") == 2
    assert "train_id" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_runs_are_packed():
    assert knn.packs({0: 5, 1: 4, 2: 3, 3: 9, 4: 1}, 9) == [[3], [0, 1], [2, 4]]
    assert knn.packs({0: 50, 1: 1}, 9) == [[0], [1]]


def test_several_searches_give_the_same_rows(spark, monkeypatch):
    first, query = fixture(seed=1, n_train=30, n_query=10)
    second, _ = fixture(seed=2, n_train=40, n_query=10)
    third, _ = fixture(seed=4, n_train=35, n_query=10)
    train = [(run, *row[1:]) for run, part in enumerate((first, second, third)) for row in part]
    asked = [(run, *row[1:]) for run in range(3) for row in query]
    t, q = frames(spark, train, asked)
    columns = ["run", "id", "rank", "train_id", "distance2"]
    whole = rows(knn.neighbours(t, q, 4), *columns)
    monkeypatch.setattr(knn, "CELLS_PER_TASK", 50)  # many slices of score pairs
    weights = features.fit(t).transform(t).select(*features.TERM, "id", "weight", "df")
    limit = max(runtime.byte_size(weights.filter(F.col("run") == run)) for run in range(3))  # every run by itself
    found = knn.neighbours(t, q, 4, limit)
    assert rows(found, *columns) == whole
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "train_id" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_scores_are_rounded_inside(spark):
    train, query = fixture()
    t, q = frames(spark, train, query)
    off = q.withColumn("sentiment", F.col("sentiment") + 0.0004)
    assert rows(knn.neighbours(t, off, 3), "id", "rank", "train_id") == rows(knn.neighbours(t, q, 3), "id", "rank", "train_id")


def indexed(rng, n, size, terms_):
    """An index of rows of random terms, the first ones in most rows, and its rows as dictionaries."""
    own = []
    for i in range(n):
        blocks = {}
        for kind in range(3):
            drawn = {int(terms_ * rng.random() ** 3) * 3 + kind: rng.random() for _ in range(rng.randint(0, size))}
            length = math.sqrt(sum(w * w for w in drawn.values()))
            blocks |= {t: w / length for t, w in drawn.items()}
        own.append((i * 3, len({t % 3 for t in blocks}), rng.randint(-9, 9) / 100, rng.randint(0, 9) / 100, rng.choice("AB"), blocks))
    own[5] = (15, *own[4][1:])
    columns = [[r[i] for r in own] for i in range(5)] + [[sorted(r[5]) for r in own], [[r[5][t] for t in sorted(r[5])] for r in own]]
    names = ["id", "blocks", "sentiment", "subjectivity", "category", "terms", "weights"]
    types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64())]
    table = pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
    return postings.build(table.take(list(reversed(range(n))))), own


def test_an_index_gives_the_rows_of_a_full_comparison_from_fewer_entries():
    rng = random.Random(6)
    index, own = indexed(rng, 400, 12, 60)
    assert index.ids.tolist() == [r[0] for r in own]
    read = {True: 0, False: 0}
    for place in range(0, 400, 7):
        query = dict(own[place][5]) if place % 2 else {t: w for t, w in own[place][5].items() if rng.random() < 0.6}
        query[10**6] = 0.3  # not in the index
        if place == 0:
            query = {}
        scores = (0.03, 0.02)
        expected = sorted(
            (round(b - 2 * sum(w * query.get(t, 0) for t, w in terms.items()) + (scores[0] - s) ** 2 + (scores[1] - u) ** 2, 9) + 0.0, i)
            for i, b, s, u, _, terms in own
        )[:6]
        terms = np.array(list(query), np.int64)
        for pruned in (True, False):
            at, distance, n = postings.nearest(index, terms, np.array(list(query.values()), float), terms % 3, scores, 6, pruned)
            assert [(pytest.approx(d, abs=2e-9), i) for d, i in expected] == list(zip(distance.tolist(), index.ids[at].tolist(), strict=True))
            read[pruned] += n
    assert read[True] < read[False]


def test_an_index_of_rows_without_terms():
    index, _ = indexed(random.Random(1), 9, 0, 5)
    assert len(index.vocabulary) == 0
    at, _, read = postings.nearest(index, np.array([1]), np.array([1.0]), np.array([0]), (0.0, 0.0), 4)
    assert len(at) == 4 and read == 0


def test_a_sample_beyond_a_broadcast_is_searched_in_slices(spark, monkeypatch):
    train, query = fixture()
    t, q = frames(spark, train, query)
    columns = ["run", "id", "rank", "train_id", "category", "distance2"]
    whole = rows(knn.neighbours(t, q, 4), *columns)
    monkeypatch.setattr(knn, "SEARCHES", 8)
    found = knn.neighbours(t, q, 4, 8_000)
    assert rows(found, *columns) == whole
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") > 1


@pytest.mark.parametrize("size", [3, 1_000], ids=["many packs", "one pack"])
def test_large_samples_pass_by_the_driver(spark, monkeypatch, size):
    first, query = fixture(seed=1, n_train=60, n_query=25)
    second, _ = fixture(seed=2, n_train=40, n_query=10)
    t, q = frames(spark, first + [(1, *row[1:]) for row in second], query + [(1, *row[1:]) for row in query])
    columns = ["run", "id", "rank", "train_id", "category", "distance2"]
    whole = rows(knn.neighbours(t, q, 7), *columns)
    monkeypatch.setattr(knn, "TEXT_BYTES", 0)
    for name in ("PACK_ROWS", "QUERY_PACK_ROWS"):
        monkeypatch.setattr(knn, name, size)

    def refused(*_):
        raise AssertionError("rows went to the driver")

    monkeypatch.setattr(type(t), "toArrow", refused)
    monkeypatch.setattr(spark.sparkContext, "broadcast", refused)
    found = knn.neighbours(t, q, 7)
    assert [(*r[:5], pytest.approx(r[5], abs=2e-9)) for r in whole] == rows(found, *columns)
    assert knn.neighbours(t, q.limit(0), 7).count() == 0


def test_terms_of_one_hash_stay_apart(spark, monkeypatch):
    train, query = fixture(n_train=20, n_query=5)
    t, q = frames(spark, train, query)
    real = features._number

    def shared(salt, block, token):
        return real(salt, block, token) if salt else real(salt, block, F.substring(token, 1, 0))

    monkeypatch.setattr(features, "_number", shared)
    bags = features.bagged(t, q)
    assert [b.count() for b in bags] == [20, 5]
    terms = {(b, w) for row in [*train, *query] for b in range(3) for w in tokens(row[2 + b])}
    found = {n for b in bags for r in b.collect() for part in r["bag"] for n in part}
    assert len(found) == len(terms)


def bag_packs(rows_, size):
    """Packs of rows ``id, bag``, and the numbers of rows that hold their terms."""
    table = pa.RecordBatch.from_pydict(
        {
            "run": pa.array([0] * len(rows_), pa.int32()),
            "id": pa.array([i for i, _ in rows_]),
            "sentiment": pa.array([0.0] * len(rows_)),
            "subjectivity": pa.array([0.0] * len(rows_)),
            "category": pa.array(["A"] * len(rows_)),
            "bag": pa.array([b for _, b in rows_], pa.list_(pa.list_(pa.int64()))),
        }
    )
    return [b.to_pylist()[0] for b in postings.packs(iter([table]), 3, size, 10**6)]


@pytest.mark.parametrize("share", [0.0, 0.01, 2.0], ids=["matrices", "both", "lists"])
def test_packs_of_other_hashtags_are_left_unread(monkeypatch, share):
    monkeypatch.setattr(postings, "DENSE", share)
    monkeypatch.setattr(postings, "ENTRIES", 50)
    rng = random.Random(2)
    own = [(i, [[rng.randrange(40) for _ in range(12)], [100 + i // 40], [200 + i // 40]]) for i in range(160)]
    packs_ = bag_packs(own, 40)
    df = Counter(t for p in packs_ for t, n in zip(p["terms"], p["held"], strict=True) for _ in range(n))
    assert df[100] == 40 and len(packs_) == 4

    def held(number, p):
        return postings.Rows(number, 0, p["head"], p["body"], np.array([df[t] for t in p["terms"]], np.int32).tobytes(), 160, 3)

    given = [held(i, p) for i, p in enumerate(packs_)]
    nearest = postings.Nearest(held(9, packs_[0]), 5)
    assert nearest.meet(given) < 160 * 40
    whole = postings.Nearest(held(9, packs_[0]), 5)
    monkeypatch.setattr(postings, "least_distances", lambda a, b: np.full((len(a.base), len(b.base)), -np.inf))
    assert whole.meet(given[::-1]) == 160 * 40
    assert whole.ids.tolist() == nearest.ids.tolist()
    assert [x.tolist() for x in whole.found()] == [x.tolist() for x in nearest.found()]


def test_runs_meet_their_posts_on_the_partitions_of_the_clusters(spark, monkeypatch):
    monkeypatch.setattr(knn, "CLUSTER_ROWS", 5)
    bags = [(i, i % 3, [[i, i + 1], [i % 4], [i % 2]]) for i in range(60)]
    posts = knn.clustered(spark.createDataFrame(bags, "id long, note int, bag array<array<bigint>>"))
    drawn = spark.createDataFrame([(run, i, "A") for run in range(2) for i in range(run, 60, 2)], "run int, id long, category string")
    drawn = runtime.stage(drawn, "test-drawn")
    columns = ["run", "id", "category", "note", "bag", "cluster"]
    found = [rows(knn.with_clusters(drawn, posts, limit), *columns) for limit in (10**6, 0)]
    assert found[0] == found[1] and len(found[0]) == 60
    assert max(Counter(r[5] for r in found[0]).values()) < 20
