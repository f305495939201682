import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from postlens.llm import packing as K, token_file as X, tokens
from postlens.llm.tokens import WordIds
from tests.llm.samples import edge_texts, edges, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text: str, end: int) -> np.ndarray:
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_words_one_by_one_give_the_text_s_ids():
    words = WordIds(PATH)
    for text in ["don't stop, it's 3.14 <|endoftext|> x<|startoftext|>y", "É́ ΟΔΟΣ οδος Σ á ́b", "a\x1cb\x85c d\xa0e", *(t or "" for _, t in edge_texts())]:
        assert np.array_equal(np.frombuffer(words.text(text.encode()) + np.array([0], "<u4").tobytes(), "<u4"), plain_ids(text, 0))


def test_any_token_of_a_shard():
    rng = np.random.default_rng(5)
    for size, top in ((0, 10), (1, 300), (5000, 70_000), (777, 2**32), (1025, 256)):
        ids = rng.integers(0, top, size, dtype=np.uint32)
        shard = X.Shard(X.build([3, None], [size // 3, size - size // 3], ids))
        places = rng.integers(0, size, 400) if size else np.empty(0, int)
        assert np.array_equal(shard.tokens_at(places), ids[places])
        for a, b in [(0, size), *(sorted(rng.integers(0, size + 1, 2).tolist()) for _ in range(30))]:
            assert np.array_equal(shard.run(a, b), ids[a:b])
        assert np.array_equal(shard.document(1), ids[size // 3 :])
        if size:
            assert shard[size - 1] == ids[-1]


def test_file_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "SHARD_TOKENS", 50)
    found = X.token_file_digest(edges(spark), PATH).orderBy("start").collect()
    want = sorted(((i, plain_ids(t, 1)) for i, t in edge_texts()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in found] == [i for i, _ in want]
    start = 0
    for r in found:
        assert r["start"] == start
        start += r["n_tokens"]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((len(x), zlib.crc32(x.tobytes())) for _, x in want)


def test_empty_tables(spark):
    assert X.token_file_digest(empty(spark), PATH).count() == 0
    assert K.packed_pieces(empty(spark), PATH).count() == 0


def test_sum_of_squares_rule():
    sizes = np.array([6, 4, 5, 3, 10, 2])
    sequence, offset = K.sum_of_squares(sizes, 10)
    counts, place, gaps = {}, [], []
    for size in sizes.tolist():  # by trying every gap
        best = None
        for gap in [*sorted({g for g in gaps if g >= size}), 10]:
            own = [g for g in gaps if g] + ([10] if gap == 10 else [])
            own.remove(gap)
            own += [gap - size] if gap > size else []
            total = sum(own.count(g) ** 2 for g in set(own))
            if best is None or total < best[0]:
                best = (total, gap)
        place.append(10 - best[1])
        if best[1] in gaps:
            gaps.remove(best[1])
        gaps.append(10 - 10 + best[1] - size)
        gaps = [g for g in gaps if g]
    assert offset.tolist() == place
    del counts


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_PIECES", 6)
    packed = K.packed_pieces(edges(spark), PATH, capacity=64)
    rows = packed.collect()
    check_layout(rows, 64)
    want = []
    for i, t in edge_texts():
        ids = plain_ids(t, 0)
        want += [(i is None, i or 0, n, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for n, at in enumerate(range(0, len(ids), 64))]
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got) == sorted(want)
    whole = {r["sequence_id"]: r["ids"] for r in K.sequences(packed).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]


def test_packing_is_close_to_the_bound(spark):
    rng = np.random.default_rng(2)
    sizes = np.minimum(2048, rng.lognormal(6, 1, 6000).astype(int) + 1)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "row long, length long")
    placed = K.pack(rows, 2048).join(rows, "row").collect()
    assert len(placed) == 6000
    assert check_layout(placed, 2048) <= 1.005 * -(-int(sizes.sum()) // 2048)


def test_new_words_are_put_together_from_parts():
    words, whole = WordIds(PATH), Tokenizer.from_file(PATH)
    signs = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x250)]] + ["'s", "<|endoftext|>", "12", "Été", "straße"]
    rng = np.random.default_rng(8)
    for size in rng.integers(1, 9, 3000).tolist():
        word = "".join(rng.choice(signs, size))
        assert words.text(word.encode()) == np.array(whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), word


def test_what_is_asked_for_again_survives(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    asked = []
    found = tokens.Remembered(lambda key: asked.append(key) or key * 2)
    for key in "abcadaeafagahaiaja":
        assert found[key] == key * 2 and len(found) <= 3 and len(found.before) <= 3
    assert asked.count("a") == 1 and len(asked) == 10
