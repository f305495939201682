"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Units are words without punctuation (letters and digits only, so that i-d-i-o-t is
one word without gaps) and runs of single characters joined (i d i o t); units beyond
24 characters are taken in overlapping windows. The kernel of two units counts their
common subsequences of three characters, each weighted by DECAY to the power of the
places that it spans in either unit: an inserted or missing character costs a little
instead of everything. It is normalised and raised to POWER. Two sentences have the
sum of their units' kernels. With landmark units Z, a sentence is the vector
K(Z, Z)^(-1/2) sum_u k(u, Z); a linear machine on it is trained on labelled sentences,
each of them once as it is and once with a character put into every word, so that the
margin asks for no more of an insult than a disguised one keeps. Units that tell a toxic
document by themselves are also put into clean sentences, with a letter more in several
places. Labels belong to whole documents, so the machine is trained again on those toxic
sentences that it set apart, and on the best one of each document without any.

Landmarks are units and beginnings of units, so that families of words count as one; a unit
counts for one family only, so that a rarer family gets its landmark beside the commonest insults.

A sentence's margin is then a sum of one number for each of its units, so a task
scores a distinct unit once. A document has the margin of its worst sentence and a share
of what its other sentences add to the bias, turned into a probability by a logistic curve that is fitted on the margins of all training
documents and of the disguised telling units, counted in narrow bins.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.llm.common import map_texts, per_task, texts
from postlens.runtime import stage

LENGTH, DECAY, POWER = 3, 0.9, 4
UNIT, STEP = 24, 12
SENTENCE_WORDS = 32
# Landmarks: families of units, telling units of these families, the commonest others.
FAMILIES, MEMBERS, COMMON = 32, 32, 32
# Beginnings of so many characters stand for a family; the least log odds of a family, by a cautious estimate, and of a unit that tells alone.
BEGINNINGS, LEAST_ODDS, LONE_ODDS = range(4, 9), 0.7, 4.0
# Disguises of a lone unit, the clean sentences that each is put into, the margin that they are to have; the weight of clean sentences.
DISGUISES, AMONG, LONE_MARGIN, CLEAN_WEIGHT = 6, 10, 2.5, 8.0
# What a sentence has to add to the bias to count beside the worst one, and the share that counts.
WEAK, SHARE = 0.3, 0.25
# The training sample: so many documents and sentences of each label at most, by hash, and the longest sentence taken.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES, SAMPLE_CHARS = 2_000, 10_000, 4_000
# Rounds of training on the sentences that tell a toxic document, if there are so many.
WITNESS_ROUNDS, LEAST_WITNESSES = 2, 20
ALPHABET = 64
LIMIT, BIN = 8.0, 0.02
REMEMBERED = 300_000
_ENDS = re.compile(r"[.!?]+(?=\s|$)|\n+")


def units(sentence: str) -> list[str]:
    """The words of a lower-cased sentence; three or more single characters in a row are one word."""
    words = sentence.split()
    if 1 not in map(len, words):
        return words
    joined, run = [], []
    for word in [*words, ""]:
        if len(word) == 1:
            run.append(word)
            continue
        joined += ["".join(run)] if len(run) >= 3 else run
        run = []
        if word:
            joined.append(word)
    return joined


def sentences(text: str) -> list[list[str]]:
    """Runs of at most SENTENCE_WORDS units between sentence ends."""
    found = []
    for part in _ENDS.split(text.lower()):
        words = units(part)
        found += [words[i : i + SENTENCE_WORDS] for i in range(0, len(words), SENTENCE_WORDS)]
    return found


def _windows(word: str) -> list[str]:
    """What the kernel sees of a word."""
    if not word.isalnum():
        word = "".join(filter(str.isalnum, word))
    if len(word) <= UNIT:
        return [word]
    return [word[i : i + UNIT] for i in range(0, len(word) - STEP, STEP)]


def _by_length(words: list[str]) -> dict[int, tuple[list[int], list[str]]]:
    """The words' windows and the places of their words, by the windows' length."""
    found: dict[int, tuple[list[int], list[str]]] = {}
    for i, word in enumerate(words):
        for window in _windows(word):
            at, own = found.setdefault(len(window), ([], []))
            at.append(i)
            own.append(window)
    return found


def _disguised(word: str, form: int = 0) -> str:
    """The word with a letter more, in its middle or, in other forms, elsewhere inside."""
    at = 1 + ((len(word) - 1) // 2 + 3 * form) % max(1, len(word) - 1)
    return word[:at] + chr(97 + (7 * len(word) + ord(word[0]) + 5 * form) % 26) + word[at:]


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as numbers below ALPHABET: a-z are 1 to 26, all else shares the rest."""
    points = np.array(words).view(np.uint32).reshape(len(words), -1)
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points % (ALPHABET - 27)).astype(np.int32)


def _triples(size: int) -> tuple[np.ndarray, np.ndarray]:
    places = np.array(list(itertools.combinations(range(size), LENGTH)))
    return places, (DECAY ** (places[:, -1] - places[:, 0] + 1)).astype(np.float32)


def own_kernel(letters: np.ndarray) -> np.ndarray:
    """Each word's kernel with itself."""
    size = letters.shape[1]
    same = (letters[:, :, None] == letters[:, None, :]).astype(np.float32) * np.float32(DECAY**2)
    gap = np.arange(size)[:, None] - np.arange(size)[None, :] - 1
    step = np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)
    held = same
    for _ in range(LENGTH - 1):
        held = same * (step @ held @ step.T)
    return held.sum(axis=(1, 2))


class Landmarks:
    """The landmarks' subsequences as a table: subsequence to row, row to a weight for each landmark."""

    def __init__(self, words: list[str]):
        rows: dict[int, np.ndarray] = {}
        for j, word in enumerate(words):
            letters = _letters([word])
            places, weight = _triples(len(word))
            codes = (letters[0][places] * np.array([ALPHABET**2, ALPHABET, 1])).sum(axis=1)
            for code, w in zip(codes.tolist(), (weight / np.sqrt(own_kernel(letters)[0])).tolist(), strict=True):
                rows.setdefault(code, np.zeros(len(words), np.float32))[j] += w
        self.size = len(words)
        self.row = np.zeros(ALPHABET**LENGTH, np.int32)
        self.row[list(rows)] = np.arange(1, len(rows) + 1)
        self.weights = np.stack([np.zeros(len(words), np.float32), *rows.values()])

    def kernel(self, words: list[str]) -> np.ndarray:
        """The normalised kernel, to POWER, of words of one length with each landmark."""
        size = len(words[0])
        out = np.zeros((len(words), self.size), np.float32)
        if size < LENGTH:
            return out
        places, weight = _triples(size)
        step = max(1, (1 << 20) // max(len(places), size * size))
        for at in range(0, len(words), step):
            letters = _letters(words[at : at + step])
            codes = (letters[:, places[:, 0]] * ALPHABET + letters[:, places[:, 1]]) * ALPHABET + letters[:, places[:, 2]]
            rows = self.row[codes]
            word, triple = np.nonzero(rows)
            if len(word):
                shares = self.weights[rows[word, triple]] * weight[triple][:, None]
                first = np.flatnonzero(np.diff(word, prepend=-1))
                hit = word[first]
                out[at + hit] = (np.add.reduceat(shares, first) / np.sqrt(own_kernel(letters[hit]))[:, None]) ** POWER
        return out


@dataclass(frozen=True)
class ToxicityModel:
    """``worth``: what a unit's kernel with each landmark adds to a sentence's margin; ``lone``: margins of clean sentences with a disguised unit that tells alone."""

    landmarks: tuple[str, ...]
    worth: tuple[float, ...]
    bias: float
    lone: tuple[float, ...] = ()


class UnitMargins:
    """The margin of each distinct word, found once."""

    def __init__(self, model: ToxicityModel):
        self.codes: dict[str, int] = {}
        self.values = np.empty(0, np.float32)
        self.landmarks = Landmarks(list(model.landmarks)) if model.landmarks else None
        self.worth = np.array(model.worth, np.float32)
        self.bias = model.bias

    def _learn(self) -> None:
        new = list(itertools.islice(self.codes, len(self.values), None))
        found = np.zeros(len(new), np.float32)
        if self.landmarks is not None:
            for at, own in _by_length(new).values():
                np.add.at(found, at, self.landmarks.kernel(own) @ self.worth if own[0] else 0)
        self.values = np.concatenate((self.values, found))

    def documents(self, texts_: list[str]) -> np.ndarray:
        """The margin of each text's worst sentence, with a share of what the others add."""
        if len(self.codes) > REMEMBERED:
            self.codes, self.values = {}, np.empty(0, np.float32)
        codes, ends, counts, known = [], [], [], self.codes
        for text in texts_:
            own = sentences(text)
            for words in own:
                codes += [known.setdefault(w, len(known)) for w in words]
                ends.append(len(codes))
            counts.append(len(own))
        self._learn()
        margins = np.full(len(texts_), self.bias)
        if codes:
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            by_sentence = np.add.reduceat(self.values[np.array(codes)].astype(np.float64), starts) + self.bias
            counts = np.array(counts)
            some = np.flatnonzero(counts)
            first = (np.cumsum(counts) - counts)[some]
            worst = np.maximum.reduceat(by_sentence, first)
            least = self.bias + WEAK
            more = np.add.reduceat(np.maximum(by_sentence - least, 0), first) - np.maximum(worst - least, 0)
            margins[some] = worst + SHARE * more
        return margins


def _heads(unit: str) -> set[str]:
    return {unit, *(unit[:n] for n in BEGINNINGS if n < len(unit))}


def _choose_landmarks(words: list[list[str]], toxic: np.ndarray, docs: np.ndarray) -> tuple[list[str], list[str]]:
    """Families that tell the labels apart, telling units within them, the commonest others; and the units that tell alone."""
    counts: dict[str, list[int]] = {}
    where: dict[str, set[int]] = {}  # the toxic documents of a unit
    seen: dict[str, int] = {}
    for own, label, doc in zip(words, toxic.tolist(), docs.tolist(), strict=True):
        found = {w for word in own for w in _windows(word) if len(w) >= LENGTH}
        for head in set().union(*map(_heads, found)) if found else ():
            counts.setdefault(head, [0, 0])[label] += 1
        for unit in found:
            seen[unit] = seen.get(unit, 0) + 1
            if label:
                where.setdefault(unit, set()).add(doc)
    share = [max(1, int((toxic == x).sum())) for x in (0, 1)]
    odds = {u: np.log((n[1] + 0.5) / (share[1] + 1)) - np.log((n[0] + 0.5) / (share[0] + 1)) for u, n in counts.items() if n[1] >= 4}
    sure = {u: odds[u] - 2 * np.sqrt(1 / (counts[u][1] + 0.5) + 1 / (counts[u][0] + 0.5)) for u in odds}
    under: dict[str, set[str]] = {}
    for unit in where:
        for head in _heads(unit):
            if sure.get(head, 0) > LEAST_ODDS:
                under.setdefault(head, set()).add(unit)
    value = {h: odds[h] * len(set().union(*(where[u] for u in own))) for h, own in under.items()}
    first, gone = [], set()
    while value and len(first) < FAMILIES and (top := max(value.values())) > 0:
        # the longest of the good ones is nearest to the units
        best = max((h for h in value if value[h] >= 0.8 * top), key=lambda h: (len(h), value[h], h))
        first.append(best)
        del value[best]
        new = under[best] - gone
        gone |= new
        for h in value:
            if under[h] & new:
                rest = under[h] - gone
                value[h] = odds[h] * len(set().union(*(where[u] for u in rest))) if rest else 0.0
    lone = [u for u in first if u in where and odds[u] > LONE_ODDS and sure[u] > LONE_ODDS / 2]
    weight = dict.fromkeys(docs.tolist(), 1.0)
    left = {u for u in gone if odds.get(u, 0) > 1 and u not in first}
    for _ in range(min(MEMBERS, len(left))):
        best = max(left, key=lambda u: (odds[u] * sum(weight[d] for d in where[u]), u))
        left.discard(best)
        first.append(best)
        for d in where[best]:  # documents that have a landmark count less
            weight[d] /= 2
    return first + sorted(set(seen) - set(first), key=lambda u: (-seen[u], u))[:COMMON], lone


def _machine(x: np.ndarray, toxic: np.ndarray, lone: np.ndarray, cost: float, rounds: int) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss; ``lone`` rows weigh as much as all other toxic ones."""
    y = np.where(toxic == 1, 1.0, -1.0)
    bad = (toxic == 1) & ~lone
    weight = np.where(lone, 0.5 / max(1, lone.sum()), np.where(bad, 0.5 / max(1, bad.sum()), CLEAN_WEIGHT * 0.5 / max(1, (toxic == 0).sum())))
    weight = weight * len(y) * cost
    aim = np.where(lone, LONE_MARGIN, 1.0)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton's steps on the sentences within the margin
        inside = y * (x @ w) < aim
        own = x[inside] * weight[inside][:, None]
        new = np.linalg.solve(ridge + own.T @ x[inside], own.T @ (y * aim)[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def train(words: list[list[str]], toxic: np.ndarray, docs: np.ndarray, cost: float = 2.0, rounds: int = 40) -> ToxicityModel:
    """A model from labelled sentences (units, 0 or 1, document). Without both labels it has no landmarks and one margin."""
    if len(set(toxic.tolist())) < 2:
        return ToxicityModel((), (), 0.0)
    chosen, alone = _choose_landmarks(words, toxic, docs)
    if not chosen:
        return ToxicityModel((), (), 0.0)
    table = Landmarks(chosen)
    identity = np.vstack([table.kernel([z]) for z in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((identity + identity.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    plain = len(words)
    forms = [_disguised(u, k) for u in alone for k in range(DISGUISES)]
    clean = [own for own, label in zip(words, toxic.tolist(), strict=True) if not label]
    forms = [[*clean[(i * AMONG + j) * len(clean) // (len(forms) * AMONG)], form] for i, form in enumerate(forms) for j in range(AMONG)]
    words = words + [[_disguised(w) for w in own] for own in words] + forms
    toxic = np.concatenate((toxic, toxic, np.ones(len(forms), int)))
    lone = np.arange(len(words)) >= 2 * plain
    known: dict[str, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for own in words for w in own], int)
    kernels = np.zeros((len(known), len(chosen)))
    for at, own in _by_length(list(known)).values():
        if own[0]:
            np.add.at(kernels, at, table.kernel(own))
    x = np.zeros((len(words), len(chosen)))
    np.add.at(x, np.repeat(np.arange(len(words)), [len(own) for own in words]), kernels[codes])
    x = np.hstack((x @ root, np.ones((len(words), 1))))
    w = _machine(x, toxic, lone, cost, rounds)
    for _ in range(WITNESS_ROUNDS):
        # most sentences of a toxic document say nothing bad: keep those beyond the margin, and the best one of a document without any
        margin = x[:plain] @ w
        told = (margin >= 1) & (toxic[:plain] == 1)
        if told.sum() < LEAST_WITNESSES:
            break
        rest = np.flatnonzero((toxic[:plain] == 1) & ~np.isin(docs, docs[told]))
        rest = rest[np.lexsort((rest, -margin[rest], docs[rest]))]
        told[rest[np.diff(docs[rest], prepend=docs[rest[:1]] - 1) != 0]] = True
        kept = np.concatenate((told, told, lone[2 * plain :])) | (toxic == 0)
        w = _machine(x[kept], toxic[kept], lone[kept], cost, rounds)
    return ToxicityModel(tuple(chosen), tuple((root @ w[:-1]).tolist()), float(w[-1]), tuple((x[lone] @ w).tolist()))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Labelled sentences and their documents: of each label the documents and then the sentences of the smallest hashes."""
    mixed = F.xxhash64("doc_id")
    picked = [labels.where(F.col("toxic") == x).orderBy(mixed, "doc_id").limit(SAMPLE_DOCUMENTS) for x in (0, 1)]
    few = stage(picked[0].unionByName(picked[1]), "labelled")  # at most two times SAMPLE_DOCUMENTS rows
    own = docs.join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "text")

    def work(batch):
        ids, toxic, found = [], [], []
        for doc, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
            lines = [line for words in sentences(text) if len(line := " ".join(words)) <= SAMPLE_CHARS]
            ids += [doc] * len(lines)
            toxic += [label] * len(lines)
            found += lines
        return {"doc_id": pa.array(ids, pa.int64()), "toxic": pa.array(toxic, pa.int32()), "sentence": pa.array(found, pa.string())}

    # a sentence counts once, however many copies of its document there are
    lines = map_texts(own, work, "doc_id long, toxic int, sentence string").groupBy("toxic", "sentence").agg(F.min("doc_id").alias("doc_id"))
    lines = stage(lines, "labelled-sentences")
    order = [F.xxhash64("sentence"), F.col("sentence")]
    rows = [r for x in (0, 1) for r in lines.where(F.col("toxic") == x).orderBy(*order).limit(SAMPLE_SENTENCES).collect()]
    return [r["sentence"].split() for r in rows], np.array([r["toxic"] for r in rows], int), np.array([r["doc_id"] for r in rows], int)


def margins(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, margin`` of ``doc_id, text``."""

    @per_task
    def start():
        known = UnitMargins(model)
        return lambda batch: {"doc_id": batch.column("doc_id"), "margin": known.documents(batch.column("text").to_pylist())}

    return map_texts(docs, start, "doc_id long, margin double")


def _curve(bins: list[tuple[float, int, int]], rounds: int = 50) -> tuple[float, float, float]:
    """Slope, offset and floor of the curve through counted ``(margin, clean, toxic)``.

    The floor is the share of label 1 where the machine sees nothing, its margin being
    below 0: labels that no sentence explains. A logistic curve takes it from there.
    """
    margin, clean, toxic = (np.array(c, float) for c in zip(*bins, strict=True))
    n = clean + toxic
    if not clean.sum() or not toxic.sum():
        return 0.0, float(np.log((toxic.sum() + 1) / (clean.sum() + 1))), 0.0
    low = margin < 0
    floor = min(0.5, (toxic[low].sum() + 0.5) / (n[low].sum() + 1)) if low.any() else 0.0
    share = np.clip((toxic / np.where(n > 0, n, 1) - floor) / (1 - floor), 0, 1)
    x = np.stack((margin, np.ones(len(margin))), axis=1)
    w = np.array([0.0, np.log((toxic.sum() + 1) / (clean.sum() + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (share - p)) - 1e-3 * w
        curve = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w += step / max(1.0, np.abs(step).max())
    return float(max(w[0], 0.0)), float(w[1]), float(floor)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, margin`` for every row of ``docs``.

    ``labels`` has ``doc_id, toxic``; labels of rows for which ``held_out`` (an
    expression of doc_id) is true or null are not learnt, nor are null labels, and of
    several labels of an id the larger counts. Null texts are empty; a text without a
    unit has the machine's bias for a margin. Texts are read whole; repeated rows get
    a row each; a row with a null id counts as held out. Without any training label
    all scores are 0.5. An empty table gives an empty result.
    """
    own = texts(docs, doc_id, text)
    out = F.coalesce(held_out, F.lit(True))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stage(known.where(~out), "training-labels")
    model = train(*_sample(own, known))
    found = stage(margins(own, model).withColumn("held_out", out), "margins")
    bin_ = F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("margin"))) / BIN)
    counted = found.join(known, "doc_id").groupBy(bin_.alias("bin")).agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("bad"))
    bins = [(r["bin"] * BIN, r["clean"], r["bad"]) for r in counted.collect()]  # at most 2 LIMIT / BIN + 1 rows
    if bins and model.lone:  # together they count like the toxic documents
        each = sum(n[2] for n in bins) / len(model.lone)
        bins += [(max(-LIMIT, min(LIMIT, m)), 0, each) for m in model.lone]
    slope, offset, floor = _curve(bins) if bins else (0.0, 0.0, 0.0)
    clipped = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("margin")))
    score = floor + (1 - floor) / (1 + F.exp(-(clipped * slope + offset)))
    return found.select("doc_id", "held_out", score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"), "margin")
