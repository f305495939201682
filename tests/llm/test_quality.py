from collections import Counter

import duckdb

from postlens.llm import quality as Q
from tests.llm.samples import edge_texts, edges, empty, of

REPEAT = "one two three four five six " * 4


def plain(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measurements_by_brute_force(spark):
    texts = [t for _, t in edge_texts()] + [REPEAT, "a b c d e a b c d e", "x\nx\n \nx", "## a | b % c", "a a a a a a a"]
    found = Q.ledger(of(spark, texts)).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert {r[0]: tuple(r)[1:] for r in found} == {i: plain(t) for i, t in enumerate(texts)}


def test_ledger_keeps_rows_and_columns(spark):
    docs = edges(spark)
    entries = Q.ledger(docs)
    assert entries.count() == len(edge_texts()) and entries.select("doc.*").columns == docs.columns
    assert Q.keep(docs).columns == docs.columns
    assert Q.ledger(empty(spark)).count() == 0


def test_policies_and_ablations(spark):
    texts = [REPEAT, "word " * 3, "A SHOUTED LINE THAT GOES ON AND ON WITH MANY DIFFERENT WORDS", "a plain line that goes on and on with many different words", "a # b # c # d # e # f # g # h # i # j"]
    entries = Q.ledger(of(spark, texts))
    rows = entries.select("doc.doc_id", "failures").collect()
    masks = {p.name: p.mask for p in (Q.BASE, Q.STRICT)}
    assert masks == {"base": 3, "strict": 127}
    got = {(r["policy"], r["rule"]): r for r in Q.ablations(entries).collect()}
    bits = {r.name: 1 << r.bit for r in Q.RULES}
    for (policy, rule), r in got.items():
        own = [x["failures"] & masks[policy] for x in rows]
        assert r["rejected"] == sum(f != 0 for f in own)
        assert r["failed"] == sum(f & bits[rule] != 0 for f in own)
        assert r["alone"] == sum(f == bits[rule] for f in own)
    kept = {r["doc_id"] for r in Q.keep(of(spark, texts)).collect()}
    assert kept == {r["doc_id"] for r in rows if r["failures"] == 0} and 3 in kept and not {0, 1, 2, 4} & kept


def test_a_filter_does_not_repeat_the_measurements(spark):
    plan = Q.keep(of(spark, ["a"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1


def test_statement(spark, tmp_path):
    docs = of(spark, [t for _, t in edge_texts() if t is None or "\x00" not in t] + [REPEAT])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(Q.OP8_SQL).fetchall()
    found = Q.ledger(docs).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", ~Q.passes(Q.BASE), Q.passes(Q.STRICT))
    assert sorted(map(tuple, found.collect())) == sorted(want)
