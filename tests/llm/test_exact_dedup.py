import hashlib
from collections import defaultdict

from postlens.llm import exact_dedup as X
from tests.llm.samples import LONG, edge_texts, edges, empty, of


def test_cuts_follow_the_content():
    gear = X._gear()
    data = LONG.encode()
    whole, shifted, none = X.cuts([data, b"something else in front " + data, b""], gear)
    assert whole[-1] == len(data) and none == []
    sizes = [b - a for a, b in zip([0, *whole], whole)]
    assert max(sizes) <= X.LONGEST and min(sizes[:-1]) >= X.SHORTEST
    ends = {len(data) - e for e in whole}
    assert len(ends & {len(data) + 24 - e for e in shifted}) > 0.9 * len(ends)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {t: (max((x for x in ids if x is not None), default=None), len(ids)) for t, ids in groups.items()}


def check(found, rows):
    want = brute(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): w for t, w in want.items()}
    assert len(found) == len(rows)
    assert all((r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]] for r in found)
    assert sum(r["kept"] for r in found) == len(want)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_groups_of_odd_rows(spark):
    check(X.exact_duplicates(edges(spark)).collect(), edge_texts())


def test_identifiers_that_collide_are_replaced(spark):
    texts = [f"{i % 40} " + "text " * (i % 40) * 30 for i in range(400)]
    assert not X._verified(of(spark, texts), 0, 8)
    check(X.exact_duplicates(of(spark, texts), bits=8).collect(), list(enumerate(texts)))


def test_empty_table(spark):
    assert X.exact_duplicates(empty(spark)).count() == 0
    assert X.without_copies(empty(spark)).columns == empty(spark).columns


def test_rows_that_stay(spark):
    left = X.without_copies(edges(spark)).collect()
    assert len(left) == len(brute(edge_texts()))
    assert {r["text"] or "" for r in left} == set(brute(edge_texts()))
    assert sum(r["doc_id"] == 5 for r in left) == 1
