import re
from collections import Counter

from postlens.llm import collocations as C
from tests.conftest import rows
from tests.llm.samples import edges, empty

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(own: list, least: int, longest: int, share: int, top: int) -> list[tuple]:
    counts: dict[str, Counter] = {}
    for lang, text in own:
        found = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = tuple(w for w in re.split("[ \t]", piece) if w)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        found[words[i : i + k]] += 1
    out = []
    for lang, found in counts.items():
        n = sum(c for w, c in found.items() if len(w) == 1)
        often = {w: c for w, c in found.items() if len(w) > 1 and c >= least}
        kept = []
        for words, a in often.items():
            inside = any(
                len(other) > len(words) and 100 * c >= share * a and any(other[i : i + len(words)] == words for i in range(len(other)))
                for other, c in often.items()
            )
            if not inside:
                score, k = min(((1000 * a * n) // (found[words[:k]] * found[words[k:]]), k) for k in range(1, len(words)))
                kept.append((-score, -a, " ".join(words).encode(), found[words[:k]], found[words[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def texts() -> list:
    import random

    rng = random.Random(4)
    words = ["the", "of", "And", "é", "a\x01", "a", "b", "New", "York", "ab", "\x00", "x\x1fy", "a b"]
    fixed = ["new york city hall park bench", "a a a a a a a", "of the of the of the"]
    out = [(lang, ". ".join(" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 9))) for _ in range(rng.randint(0, 6)))) for lang in ("en", "de", None) for _ in range(60)]
    out += [("en", rng.choice(fixed)) for _ in range(60)] + [("en", fixed[0])] * 30 + [("en", None), ("fr", ""), ("und", "the\tof"), ("x", " \n.,;")]
    return out


def check(spark, least, longest, share, top, partitions):
    own = texts()
    docs = spark.createDataFrame([(l, t, 1, "c") for l, t in own], "lang string, text string, n long, words string").repartition(partitions)
    assert rows(C.collocations(docs, least, longest, share, top), *COLUMNS) == plain(own, least, longest, share, top)


def test_rows_are_those_of_plain_counting(spark):
    check(spark, 5, 5, 100, 2000, 7)
    check(spark, 3, 5, 60, 20, 1)


def test_sums_and_borrowed_phrases_go_over_range_borders(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, 2, 4, 100, 2000, 3)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_flushes_and_a_crowded_sketch_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "HELD", 3)
    monkeypatch.setattr(C, "LEAST_BITS", 3)
    monkeypatch.setattr(C, "MOST_BITS", 3)
    check(spark, 6, 5, 100, 2000, 4)


def test_large_counts_stay_exact(spark):
    stream = spark.createDataFrame([("en", ["a"], 3 * 10**12), ("en", ["b"], 10**13), ("en", ["a", "b"], 10**12)], "lang string, words array<string>, n long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, total long")
    patched, C.phrase_counts = C.phrase_counts, lambda *_: (stream, totals)
    try:
        assert rows(C.collocations(None), "score") == [((1000 * 10**12 * 10**14) // (3 * 10**12 * 10**13),)]
    finally:
        C.phrase_counts = patched


def test_edges(spark):
    found = C.collocations(edges(spark), least=1)
    assert {r["lang"] for r in found.select("lang").collect()} == {"und"} and found.count() == 2000
    assert C.collocations(empty(spark)).count() == 0
