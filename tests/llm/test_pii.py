import hashlib
import random
import re

import numpy as np

from postlens.llm import pii as P
from tests.llm.samples import edge_texts, edges, empty, of

BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text: str) -> list[tuple[int, int, int]]:
    found = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                True,
                kind == 1 and all(int(x) <= 255 for x in m[0].split(".")),
                13 <= len(digits) <= 19 and P.luhn(digits),
                9 <= len(digits) <= 15,
            )[kind]
            if ok:
                found.append((kind, *m.span()))
    return found


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(2)
    parts = ["a", "b@c.de", "@", ".", "x.y@z", "1", "23", "255", "256", "10.0.0.1", "4111111111111111", "4111 1111-1111 1111", " ", "-", "+", "+1 (017) 555-7713", "(", ")", "%", "é", "00", "5500005555555559", "_"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert P.base_spans(text) == plain(text), text
    assert P.base_spans("7" * 50_000 + "." * 1000 + "@" * 50_000 + "a" * 50_000) == plain("7" * 50_000)


def test_estimates_tell_good_labelers_from_bad_ones():
    rng = np.random.default_rng(0)
    counts, truth = np.zeros(P.PATTERNS), {}
    for _ in range(4000):
        real = rng.random() < 0.6
        own = [(1 if real else -1) if rng.random() < r else (-1 if real else 1) for r in (0.95, 0.9, 0.9, 0.55, 0.85)]
        code = P._code(3, tuple(own))
        counts[code] += 1
        truth.setdefault(code, []).append(real)
    posterior, reliability = P.estimate(counts)
    assert reliability[3, 0] > 0.85 and reliability[3, 3] < 0.7
    patterns = np.flatnonzero(counts)
    weights = P.train(patterns, np.zeros(len(patterns), int), counts[patterns], posterior)
    accepts = P.SpanClassifier(tuple(weights), ()).accepts(np.arange(P.PATTERNS), np.zeros(P.PATTERNS, int))
    right = sum(sum(r == (accepts[c] >= 0.5) for r in own) for c, own in truth.items())
    assert right > 0.95 * 4000


def test_added_spans_and_what_is_left_alone(spark):
    texts = [
        "please call our desk tel. 020-7946-0958 or 00 44 20 7946 0958 today",
        "write to jane.doe (at) example (dot) com about it",
        "paid by visa card 4111.1111.1111.1111 yesterday",
        "version 10.2.3.4567 of chapter 12-13-14 in section 1234-5678-9012-3456",
        "nothing to see at home dot here, the year 1999 and 2000",
    ]
    texts += ["mail a.b@c.com, tel +1 (017) 555-7713, card 4111111111111111, host 10.1.2.3"] * 20
    found = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["stop"]]) for s in r["added"]] for r in P.find_personal_data(of(spark, texts)).collect()}
    assert (3, "00 44 20 7946 0958") in found[0]
    assert (0, "jane.doe (at) example (dot) com") in found[1]
    assert (2, "4111.1111.1111.1111") in found[2]
    assert found[3] == found[4] == []
    assert not any(found[i] for i in range(5, 25))


def test_digest(spark):
    texts = [t or "" for _, t in edge_texts()]
    found = P.span_digest(P.find_personal_data(edges(spark))).collect()
    assert len(found) == len(texts)
    wants = {}
    for t in texts:
        spans = plain(t)
        listed = ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        counts = tuple(sum(k == x for k, _, _ in spans) for x in range(4))
        wants[(*counts, hashlib.sha256(listed.encode()).hexdigest(), listed)] = True
    for r in found:
        assert tuple(r)[1:] in wants
    assert next(r for r in found if r["doc_id"] == 12)["spans"].count(":") == 6


def test_redaction(spark):
    docs = edges(spark)
    cleaned = P.redact(docs)
    assert cleaned.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in cleaned.where("doc_id in (1, 4, 12)").collect()}
    assert got[1] is None and got[4] == dict(edge_texts())[4]
    assert got[12] == "[PHONE] [EMAIL] [IP]"
    assert P.redact(empty(spark)).count() == 0 and P.find_personal_data(empty(spark)).count() == 0


def test_a_spelt_address_is_a_candidate_in_any_text():
    for text in ("write to jane at example.com today", "write to jane at example.com today @"):
        assert [text[s:e] for _, s, e in P.loose_spans(text, [])] == ["jane at example.com"]


PROSE = [
    "The thing inged at rewhre. In the end this ended at. Be there", "This at ntat.\nBe at and. It was", "look at example.com for more", "at home.It rained at noon.no doubt",
    "meet us at the bar. De facto, at es. Me too", "a @ b, c at d. e", "Nd at Nd. At last at us. In it",
]


def test_prose_has_no_added_spans(spark):
    found = P.find_personal_data(of(spark, PROSE + ["write to jane at example.com today", "mail me @ jane @ example.org"] + ["mail a.b@c.com and +1 (017) 555-7713"] * 5)).collect()
    added = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["added"]] for r in found}
    assert not any(added[i] for i in range(len(PROSE)))
    assert added[len(PROSE)] == [(0, 9)]


def test_clean_documents_are_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = P.find_personal_data(docs).where("size(added) > 0").join(docs, "doc_id")
    assert [r["text"][s["start"] : s["stop"]] for r in found.collect() for s in r["added"]] == []


def test_signs_reach_the_classifier():
    patterns = np.array([P._code(3, (1, 0, 0, 1, 1))] * 2)
    # the same votes; those with a colon before are data
    posterior = np.full(P.PATTERNS, 0.5)
    posterior[P._code(3, (1, 1, 1, 1, 1))], posterior[P._code(3, (-1, -1, -1, -1, -1))] = 0.99, 0.01
    sure = np.array([P._code(3, (1, 1, 1, 1, 1)), P._code(3, (-1, -1, -1, -1, -1))])
    weights = P.train(np.concatenate((patterns, sure)), np.array([8, 0, 8, 0]), np.array([5.0, 5.0, 200.0, 200.0]), posterior)
    high, low = P.SpanClassifier(tuple(weights), ()).accepts(patterns, np.array([8, 0]))
    assert high > low


def test_many_candidates_of_one_text_take_time_in_proportion():
    import time

    def spent(n):
        text = " ".join(f"{1000 + i}-{i % 90 + 10:02d}-{i % 9000 + 1000}" for i in range(n))
        begin = time.perf_counter()
        assert len(P.loose_spans(text, [])) >= n // 3
        return time.perf_counter() - begin

    spent(1000)
    assert spent(20_000) < 60 * max(spent(1000), 0.01)


def test_redaction_of_overlapping_spans_and_odd_columns(spark):
    docs = spark.createDataFrame([("a@1.2.3.4 b", 1, "x"), ("\U0001f600 +4111111111111111 é", 2, "y"), (None, 3, "z")], "text string, base int, loose string")
    assert [tuple(r) for r in P.redact(docs).orderBy("base").collect()] == [("[EMAIL] b", 1, "x"), ("\U0001f600 +[CARD] é", 2, "y"), (None, 3, "z")]
