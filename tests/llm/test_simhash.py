import numpy as np
import xxhash

from postlens.llm import simhash as S
from postlens.llm.common import linked_groups
from tests.conftest import rows
from tests.llm.samples import edge_texts, edges, empty, of


def plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    size, counts, hashes = min(3, len(words)), [0] * 64, 0
    for i in range(len(words) - size + 1 if words else 0):
        value = xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42)
        hashes += 1
        for bit in range(64):
            counts[bit] += value >> bit & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > hashes)


def plain_components(prints: dict) -> dict:
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = new


def gray_sorted(codes: np.ndarray) -> np.ndarray:
    rank = np.unique(codes)
    codes = rank.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return codes[np.argsort(rank)]


def test_spanning_links_connect_the_same_codes():
    rng = np.random.default_rng(3)
    for size, other in ((1, None), (60, None), (900, 700), (3000, None)):
        seeds = rng.integers(0, 2**63, 30, dtype=np.uint64)

        def codes(n):
            own = seeds[rng.integers(0, 30, n)].copy()
            for _ in range(4):
                own ^= np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
            return gray_sorted(own)

        left, right = codes(size), codes(other) if other else None
        a, b = S.spanning_links(left, right, 3)
        every = left if right is None else np.concatenate((left, right))
        assert len(a) < len(every)

        def groups(pairs):
            root = {c: c for c in every.tolist()}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for x, y in pairs:
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            return {c: find(c) for c in root}

        to = left if right is None else right
        i, j = np.nonzero(np.bitwise_count(left[:, None] ^ to[None, :]) <= 3)
        assert groups(zip(a.tolist(), b.tolist())) == groups(zip(left[i].tolist(), to[j].tolist()))


def test_fingerprints_and_components_by_brute_force(spark):
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(200)])
    texts = [" ".join(rng.choice(words, 120)) for _ in range(30)]
    texts += [" ".join(t.split()[:-1] + ["other"]) for t in texts[:15]] + texts[:3] + ["", "one two"]
    found = S.simhash_groups(of(spark, texts), block=16).collect()
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(prints)
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in found} == prints
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert len(set(want.values())) < len(texts)


def test_odd_rows(spark):
    found = S.simhash_groups(edges(spark)).collect()
    assert len(found) == len(edge_texts())
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in found if r["doc_id"] in (4, 5, 6)} == {4}
    kept = S.one_of_each(edges(spark))
    assert kept.columns == edges(spark).columns
    assert {1, 4} <= {r["doc_id"] for r in kept.collect()} and not {2, 3, 5, 6} & {r["doc_id"] for r in kept.collect()}


def test_empty_table(spark):
    assert S.simhash_groups(empty(spark)).count() == 0


def test_linked_groups(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = rows(linked_groups(spark.createDataFrame(pairs, "a long, b long"), "t"), "node", "root")
    assert got == sorted([(i, 1) for i in range(1, 41)] + [(90, 90), (95, 90), (100, 90)])


def test_a_pair_of_blocks_needs_little_memory():
    import tracemalloc

    codes = np.random.default_rng(5).integers(0, 2**63, 1 << 15, dtype=np.uint64)
    left, right = gray_sorted(codes[: 1 << 14]), gray_sorted(codes[1 << 14 :])
    tracemalloc.start()
    S.spanning_links(left, right, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
