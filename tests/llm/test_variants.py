import random
import re
import zlib
from collections import Counter

import pytest

from postlens.llm import variants as V
from tests.conftest import rows
from tests.llm.samples import edges, empty

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def plain(own: list, every: int = 199) -> list[tuple]:
    counts = Counter()
    for doc_id, text in own:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, found = {}, {}
    for word, n in words.items():
        others = [(-m, w) for w, m in words.items() if near(word, w)]
        best = min(others, default=None)
        forms[word] = best[1] if best and -best[0] >= 5 * n else None
        found[word] = n, len(others), -best[0] if forms[word] else None
    out = []
    for word in words:
        root = word
        while forms[root]:
            root = forms[root]
        out.append((word, forms[word], root, *found[word]))
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


def vocabulary(seed: int = 2) -> list[str]:
    """Words of few letters with many edits of one another, and their edits' edits."""
    rng = random.Random(seed)
    words = {"".join(rng.choices("abcé÷", k=rng.randint(5, 9))) for _ in range(60)} | {"aaaaaaaa", "ababababab", "ÿÿÿÿÿÿ"}
    for _ in range(2):
        for word in sorted(words):
            at = rng.randrange(len(word) + 1)
            words |= {word[:at] + rng.choice("abcé") + word[at:], word[:at] + word[at + 1 :], word[:at] + rng.choice("abc") + word[at + 1 :]}
    return sorted(words)


def corpus() -> list:
    rng = random.Random(8)
    words = vocabulary()
    own = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights=[1 / (1 + j % 50) ** 2 for j in range(len(words))], k=60))) for i in range(300)]
    return own + [own[0], (None, own[1][1]), (301, None), (302, ""), (303, "1 2 _é× 9")]


def frame(spark):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in corpus()], "doc_id long, text string, word string, n long").repartition(5)


def test_bounds_hold_for_every_edit():
    rng = random.Random(1)
    words = vocabulary()
    for limit in (0, 3, 30, 10**6):
        full = Counter()
        for word in words:
            marked = V.FIRST + word + V.LAST
            full.update(marked[p : p + q] for q in (2, 3, 4) for p in range(len(marked) - q + 1))
        grams = V.Grams({g: n for g, n in full.items() if len(g) == 2 or full[g[:-1]] > limit})
        for word in rng.sample(words, 80):
            marked = V.FIRST + word + V.LAST
            parts = grams.parts(marked)
            bound = grams.bound(marked, parts)
            for at in range(len(word) + 1):
                for other in {word[:at] + c + word[at + more :] for c in ("", "a", "b", "c", "z") for more in (0, 1)} - {word}:
                    moved = len(other) - len(word)
                    theirs = {(("\x02" + other + "\x03")[p:e], p) for p, e in grams.parts("\x02" + other + "\x03")}
                    stay = sum((marked[p:e], p) in theirs or (marked[p:e], p + moved) in theirs for p, e in parts)
                    assert stay >= bound, (word, other, limit)


@pytest.mark.parametrize(("limit", "most", "block"), [(2000, 1 << 17, 1024), (3, 1 << 17, 2), (0, 40, 16)])
def test_rows_are_those_of_plain_comparison(spark, limit, most, block):
    expected = plain(corpus())
    assert sum(r[1] is not None for r in expected) > 20 and any(r[2] != (r[1] or r[0]) for r in expected)
    assert rows(V.spelling_variants(frame(spark), limit=limit, most=most, block=block), *COLUMNS) == expected


def test_words_without_a_bound_are_found_by_halves(spark, monkeypatch):
    monkeypatch.setattr(V, "LONGEST_GRAM", 7)
    assert rows(V.spelling_variants(frame(spark), limit=0), *COLUMNS) == plain(corpus())


def test_flushes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD", 4)
    assert rows(V.spelling_variants(frame(spark), every=7), *COLUMNS) == plain(corpus(), 7)


def test_edges(spark):
    found = V.spelling_variants(edges(spark), least=1, every=0)
    assert rows(found.where("word = 'amused'"), *COLUMNS) == [("amused", None, "amused", 5, 0, None)]
    assert V.spelling_variants(empty(spark)).count() == 0
