import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from postlens.llm import sentencepieces as S
from tests.llm.samples import edge_texts, edges, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")


def model_bytes() -> bytes:
    with open(PATH, "rb") as file:
        return file.read()


def as_unigram(data: bytes) -> bytes:
    """The same pieces and scores under the other kind of model: byte 2 of field 3 of the trainer's part."""
    at = data.index(b"\x12\x06tok_v0\x18\x02") + 9
    return data[:at] + b"\x01" + data[at + 1 :]


def samples() -> list[str]:
    rnd = random.Random(4)
    parts = [" ", "  ", "   ", "the", "ing", "ion", ".", ",", "\n", "\t", "é", "日本", "語", "ü", "ß", "\U0001f600", "▁", "x", "1", "23", "()", "//", "==", "</s>", "<0x41>", "\x00", "Straße", "ab" * 9]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(1500)] + [t or "" for _, t in edge_texts()]


def test_bpe_equals_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model = S.PieceModel(model_bytes())
    texts = samples()
    got = [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)]
    assert got == library.encode(texts, num_threads=1)
    assert [model.decode(np.array(x, "<u4").tobytes()) for x in got] == library.decode(got)


def test_unigram_equals_the_library():
    data = as_unigram(model_bytes())
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = S.PieceModel(data)
    assert model.kind == S.UNIGRAM
    # marks by themselves and unknown characters score -1e9, beside which single precision loses all others;
    # the library's lattice search is compared, as its quick one does not always find the largest sum
    texts = [t for t in samples() if len(t) < 300]
    found = [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)]
    clear = [(t, x) for t, x in zip(texts, found, strict=True) if x and all(model.scores[i] > -1e8 and model.types[i] == S.NORMAL for i in x)]
    assert len(clear) > 100
    for text, own in clear:  # sums of ranks tie often
        best = library.nbest_encode_as_ids(text, 2)[0]  # one alone is searched the quick way
        assert sum(model.scores[i] for i in own) == sum(model.scores[i] for i in best)
        assert "".join(model.pieces[i] for i in own) == "".join(model.pieces[i] for i in best)


def test_units_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 10)
    monkeypatch.setattr(S, "PAIRS", 5)
    model, other = S.PieceModel(model_bytes()), S.PieceModel(model_bytes())
    texts = samples()[:60]
    whole = other.encode(texts)
    assert [model.encode([t])[0] for t in texts] == whole


def test_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = S.round_trip(edges(spark), PATH).collect()
    want = sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in library.encode([t or "" for _, t in edge_texts()], num_threads=1))
    assert sorted((r["n_pieces"], r["ids_crc32"]) for r in found) == want
    assert all(r["same_text"] for r in found)
    back = S.decoded(S.encoded(edges(spark), PATH), PATH).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in back) == sorted(((i or 0), t or "") for i, t in edge_texts())
    assert S.round_trip(empty(spark), PATH).count() == 0
