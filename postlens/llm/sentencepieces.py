"""SentencePiece encoding and decoding by a batched Viterbi search.

A text is cut wherever no piece of the vocabulary holds the two characters next to
each other in that order; a cut there changes no result. What lies between, mostly
words with the mark before them, is encoded once per task. Units of equal length
advance together as one matrix: rolling hashes give the hash of any substring of all
units at once, they probe the sorted hashes of the pieces (and the characters are
compared, so a hash never decides), and for each end position the best of all pieces
that end there is found for all units at once; its length is the backpointer.

What is best depends on the model file:

* unigram: the largest sum of scores, a longer piece winning a tie;
* BPE: merging by score is not a sum. But its result is the one path on which each
  piece is what merging makes of its own characters, and each two neighbours are
  what merging makes of theirs. So a path to a place is admissible if it extends the
  admissible path to where its last piece starts, and its last two pieces pass; there is
  always exactly one. Pairs are tried by merging once and remembered.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postlens.llm.common import map_texts, per_task, texts, worker_state

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
# Units kept with their ids, as many again from before, so that what is common survives; and pairs.
REMEMBERED, PAIRS = 250_000, 2_000_000
UNKNOWN_PENALTY = 10.0
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Cells (units x substrings) of a batch.
CELLS = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class _Pairs(dict):
    """Whether merging the characters of two pieces gives these two pieces; key: both numbers in one."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        a, b = key >> 21, key & ((1 << 21) - 1)
        one, two = self.model.string(a) if a < self.model.start else "", self.model.string(b)
        found = self[key] = self.model.merged(one + two) == ([one, two] if one else [two])
        return found


class PieceModel:
    """A model file. Normalisation must be the identity but for the marks of spaces."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types, self.kind = [], [], [], UNIGRAM
        prefix, squeeze, charsmap = True, True, b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                prefix, squeeze, charsmap = own.get(3, 1), own.get(4, 1), own.get(2, b"")
        if charsmap or squeeze or not prefix or self.kind not in (UNIGRAM, BPE) or {USER, UNUSED} & set(self.types):
            raise ValueError("only unigram and BPE models with plain normalisation, a first mark and ordinary pieces are read")
        self.size = len(self.pieces)
        self.start = (1 << 21) - 1  # stands for the beginning of a unit
        normal = [i for i, t in enumerate(self.types) if t == NORMAL]
        self.number = {self.pieces[i]: i for i in normal}
        self.unknown = self.types.index(UNKNOWN)
        bytes_ = {int(self.pieces[i][1:-1], 16): i for i, t in enumerate(self.types) if t == BYTE}
        self.bytes = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.neighbours = {p[i : i + 2] for p in self.number for i in range(len(p) - 1)}
        self.together = np.array(sorted(ord(a) << 32 | ord(b) for a, b in self.neighbours), np.uint64)
        self.marks_lead = not any(b == MARK != a for a, b in self.neighbours)
        keys = {self._hash(p): i for p, i in self.number.items()}
        if len(keys) != len(self.number):
            raise ValueError("two pieces share a hash")
        order = sorted(keys)
        self.keys, self.ids = np.array(order, np.uint64), np.array([keys[k] for k in order], np.int32)
        self.letters = np.zeros((self.size, self.longest), np.uint32)
        for p, i in self.number.items():
            self.letters[i, : len(p)] = [ord(c) for c in p]
        self.worth = np.array(self.scores, np.float32)
        self.unknown_worth = np.float32(min(self.scores[i] for i in normal) - UNKNOWN_PENALTY)
        self.pairs = _Pairs(self)
        self.units: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.out = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * MULTIPLIER + ord(c) + 1) & (2**64 - 1)
        return (value + len(piece) * 0xD6E8FEB86659FD93) & (2**64 - 1)

    def string(self, number: int) -> str:
        """A piece, or the character that is none."""
        return self.pieces[number] if number < self.size else chr(number - self.size)

    def merged(self, text: str) -> list[str]:
        """BPE of a short string, by the rule: the neighbours whose union scores best, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, place = -np.inf, -1
            for i in range(len(parts) - 1):
                found = self.number.get(parts[i] + parts[i + 1])
                if found is not None and self.scores[found] > best:
                    best, place = self.scores[found], i
            if place < 0:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def _cut(self, units: list[str]) -> list[list[str]]:
        """Units cut where no piece can cross, all of them at once."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        pairs = points[:-1].astype(np.uint64) << np.uint64(32) | points[1:]
        at = np.minimum(np.searchsorted(self.together, pairs), len(self.together) - 1)
        apart = self.together[at] != pairs if len(self.together) else np.ones(len(pairs), bool)
        apart[ends[:-1] - 1] = False  # between two units
        cuts = np.flatnonzero(apart) + 1
        found = [[u] for u in units]
        if not len(cuts):
            return found
        own = np.searchsorted(ends, cuts, side="right")
        begins = ends - np.fromiter(map(len, units), np.int64, len(units))
        first = np.flatnonzero(np.diff(own, prepend=-1))
        inner = (cuts - begins[own]).tolist()
        for unit, start, stop in zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
            places, text = inner[start:stop], units[unit]
            found[unit] = [text[x:y] for x, y in zip([0, *places], [*places, None], strict=True)]
        return found

    def learn(self, wanted: list[str]) -> None:
        """Encode units that are not known yet, and keep them."""
        parts = self._cut(wanted)
        new = {p for own in parts for p in own} - self.units.keys()
        kept = new & self.before.keys()
        self.units.update((p, self.before[p]) for p in kept)
        by_length: dict[int, list[str]] = {}
        for p in new - kept:
            by_length.setdefault(len(p), []).append(p)
        for size, own in by_length.items():
            step = max(1, CELLS // (size * min(size, self.longest)))
            for at in range(0, len(own), step):
                batch = own[at : at + step]
                self.units.update(zip(batch, self._search(batch, size), strict=True))
        known = self.units.__getitem__
        self.units.update((unit, b"".join(map(known, own))) for unit, own in zip(wanted, parts, strict=True) if len(own) > 1)

    def _search(self, words: list[str], size: int) -> list[bytes]:
        """The ids (uint32 bytes) of words of one length."""
        count = len(words)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(count, size)
        prefix = np.zeros((count, size + 1), np.uint64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * np.uint64(MULTIPLIER) + letters[:, j] + np.uint64(1)
        longest = min(size, self.longest)
        piece = np.full((longest + 1, count, size), -1, np.int32)  # by length, word and start
        power = 1
        for length in range(1, longest + 1):
            power = power * MULTIPLIER & (2**64 - 1)
            hashes = prefix[:, length:] - prefix[:, :-length] * np.uint64(power) + np.uint64(length * 0xD6E8FEB86659FD93 & (2**64 - 1))
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            word, start = np.nonzero(self.keys[at] == hashes)
            found = self.ids[at[word, start]]
            same = np.ones(len(found), bool)
            for i in range(length):
                same &= letters[word, start + i] == self.letters[found, i]
            piece[length, word[same], start[same]] = found[same]
        lone = piece[1] < 0  # characters that are no piece
        piece[1][lone] = self.size + letters[lone].astype(np.int32)
        back = (self._best_sums if self.kind == UNIGRAM else self._admissible)(piece, longest, count, size)
        return self._follow(piece, back, count, size)

    def _best_sums(self, piece: np.ndarray, longest: int, count: int, size: int) -> np.ndarray:
        best = np.full((count, size + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back = np.zeros((count, size + 1), np.int32)
        for end in range(1, size + 1):
            lengths = np.arange(min(end, longest), 0, -1)  # the longest first: it wins a tie
            own = np.stack([piece[n, :, end - n] for n in lengths])
            worth = np.where(own < 0, -np.inf, np.where(own < self.size, self.worth[np.clip(own, 0, self.size - 1)], self.unknown_worth)).astype(np.float32)
            sums = np.stack([best[:, end - n] for n in lengths]) + worth
            choice = sums.argmax(axis=0)
            back[:, end], best[:, end] = lengths[choice], sums[choice, np.arange(count)]
        return back

    def _admissible(self, piece: np.ndarray, longest: int, count: int, size: int) -> np.ndarray:
        last = np.full((count, size + 1), -1, np.int64)
        last[:, 0] = self.start
        back = np.zeros((count, size + 1), np.int32)
        for end in range(1, size + 1):
            lengths = np.arange(1, min(end, longest) + 1)
            own = np.stack([piece[n, :, end - n] for n in lengths])
            before = np.stack([last[:, end - n] for n in lengths])
            row, word = np.nonzero((own >= 0) & (before >= 0))
            chosen = own[row, word].astype(np.int64)
            pairs, place = np.unique(before[row, word] << 21 | chosen, return_inverse=True)
            passes = np.fromiter(map(self.pairs.__getitem__, pairs.tolist()), bool, len(pairs))[place]
            row, word, chosen = row[passes], word[passes], chosen[passes]
            back[word, end], last[word, end] = lengths[row], chosen
        return back

    def _follow(self, piece: np.ndarray, back: np.ndarray, count: int, size: int) -> list[bytes]:
        at, every, steps = np.full(count, size), np.arange(count), []
        while at.any():
            length = back[every, at]
            start = at - length
            steps.append(np.where(length > 0, piece[length, every, np.maximum(start, 0)], -1))
            at = start
        ids = np.stack(steps[::-1], axis=1)
        if not (ids >= self.size).any():
            return [row[row >= 0].astype("<u4").tobytes() for row in ids]
        found = []
        for row in ids.tolist():
            own = []
            for x in row:
                if x >= self.size:
                    own += [self.bytes[b] for b in chr(x - self.size).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
                elif x >= 0:
                    own.append(x)
            found.append(np.array(own, "<u4").tobytes())
        return found

    def encode(self, texts_: list[str]) -> list[bytes]:
        """The ids of whole texts, as uint32 bytes. An empty text has none."""
        cut = [_UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts_]
        if not self.marks_lead:
            cut = [["".join(own)] if own else [] for own in cut]
        every = set().union(*cut)
        if len(self.units) > REMEMBERED:
            self.before, self.units = self.units, {}
        missing = every - self.units.keys()
        kept = missing & self.before.keys()
        self.units.update((u, self.before[u]) for u in kept)
        if missing := list(missing - kept):
            self.learn(missing)
        known = self.units.__getitem__
        return [b"".join(map(known, own)) for own in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; what is no UTF-8 becomes U+FFFD."""
        text = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def load(path: str) -> PieceModel:
    """The model of a file, read once for each Python worker."""

    def read() -> PieceModel:
        with open(path, "rb") as file:
            return PieceModel(file.read())

    return worker_state(f"pieces:{path}", read)


def encoded(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pieces, ids`` (uint32 bytes) of every row.

    Null and empty texts have no pieces; texts are read whole; repeated rows and null
    ids get a row each; an empty table gives an empty result. ``model`` is a file that
    every executor can open.
    """

    @per_task
    def start():
        pieces = load(model)

        def work(batch):
            ids = pieces.encode(batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "n_pieces": [len(x) // 4 for x in ids], "ids": pa.array(ids, pa.binary())}

        return work

    return map_texts(texts(docs, doc_id, text), start, "doc_id long, n_pieces long, ids binary")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts_ = [pieces.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts_, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, same_text``: digests of the ids, and whether they decode to the text they came from."""

    @per_task
    def start():
        pieces = load(model)

        def work(batch):
            own = batch.column("text").to_pylist()
            ids = pieces.encode(own)
            return {
                "doc_id": batch.column("doc_id"),
                "n_pieces": [len(x) // 4 for x in ids],
                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                "same_text": [pieces.decode(x) == t for x, t in zip(ids, own, strict=True)],
            }

        return work

    return map_texts(texts(docs, doc_id, text), start, "doc_id long, n_pieces long, ids_crc32 long, same_text boolean")
