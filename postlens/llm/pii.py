"""Personal data by weak supervision.

Each text is read for *base* spans, which are always reported, and for *candidates*:
whatever else has a loose shape of one of the kinds (an address spelt out with "at"
and "dot", a number without a plus sign, a card number in other groups). Labelers
vote 1, -1 or 0 (no opinion) on every base span and candidate: shape, gazetteers of
name endings, calling codes and card ranges, words that stand before, what touches
the span, and how its digits look. The votes are counted over all documents; each
distinct pattern of votes is one row, so expectation-maximisation (Dawid and Skene)
over the patterns estimates every labeler's reliability, and from its posteriors a
logistic classifier of spans is trained, which also sees what the labelers do not: a few
signs of the span itself and of what stands around it. Candidates that it accepts are added.

A bare dot in a spelt-out address has no white space around it, and a bare "at" needs a
domain in lower case and a word such as mail or write before it: prose is full of both.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.common import map_texts, stage_packed, texts
from postlens.runtime import stage

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "gazetteer", "context", "border", "digits")
# Characters before a span that the context labeler reads.
BEFORE = 48
ACCEPT = 0.5

# Name endings, two-digit calling codes and first digits of card ranges in public use.
ENDINGS = frozenset("com org net edu gov int mil io co info biz dev app me tv ai de fr es uk us it nl be ch at se no dk fi pl pt ie eu ca au nz jp cn in br mx ar cl za ru example test".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ZONES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
CUES = (
    re.compile(r"e-?mail|mail|contact|write|reach|address|correo|courriel|adresse", re.I),
    re.compile(r"\bip\b|server|host|address|login|log-?in|from|serveur|rechner", re.I),
    re.compile(r"card|visa|master|amex|credit|debit|payment|carte|karte|tarjeta", re.I),
    re.compile(r"tel|phone|call|fax|mobile|cell|ring|whatsapp|rufen|appel|llam", re.I),
)
COUNTER = re.compile(r"version|chapter|section|isbn|issn|order|article|serial|sku|invoice|page|figure|token|hash|sha|commit|v\.?\s*$", re.I)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_AT = r"(?:\s?@\s?|\s{0,2}(?:\(at\)|\[at\]|\{at\})\s{0,2}|\sat\s)"
_DOT = r"(?:\.|\s{0,2}(?:\(dot\)|\[dot\]|\{dot\})\s{0,2}|\sdot\s)"
_LOOSE = (
    re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I),
    re.compile(r"(?<![0-9.\[(])[0-9]{1,3}(?:\[\.\]|\(\.\)|\s?\.\s?)[0-9]{1,3}(?:\[\.\]|\(\.\)|\s?\.\s?)[0-9]{1,3}(?:\[\.\]|\(\.\)|\s?\.\s?)[0-9]{1,3}(?![0-9])"),
    re.compile(r"(?<![0-9])[0-9]{4}(?:[._/\x20-]{1,2}[0-9]{2,6}){2,4}(?![0-9])"),
    re.compile(r"(?<![\w.+-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![\w-])"),
)
_BARE_AT = re.compile(r"\sat\s", re.I)
_SPELT = re.compile(r"[(\[{]dot[)\]}]|\sdot\s|[(\[{]at[)\]}]|\sat\s", re.I)


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        if i % 2:
            value = 2 * value - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, stop)`` in code points, by kind and start; leftmost, non-overlapping within a kind."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:  # only what surrounds an @ can match: the run before it, as far as it is free, and a domain
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        found += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if _card(_digits(m[0]))]
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def _spelt_out(text: str, match: re.Match) -> bool:
    """Whether words around a bare "at" are an address: a known ending in lower case, and a word that announces one."""
    domain = re.sub(r"\s", "", re.sub(_DOT, ".", _BARE_AT.split(match[0])[-1], flags=re.I))
    return domain.islower() and domain.rpartition(".")[2] in ENDINGS and CUES[0].search(text[max(0, match.start() - BEFORE) : match.start()]) is not None


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, clear of the base spans and of each other."""
    kinds = []
    if _SPELT.search(text) or "@" in text:
        kinds.append(0)
    if _DIGIT.search(text):
        kinds += [1, 2, 3]
    # taken stretches, joined where they overlap, in order
    starts, stops = [], []
    for s, e in sorted((s, e) for _, s, e in base):
        if stops and s < stops[-1]:
            stops[-1] = max(stops[-1], e)
        else:
            starts.append(s)
            stops.append(e)
    found = []
    for kind in kinds:
        for m in _LOOSE[kind].finditer(text):
            digits = _digits(m[0])
            if kind == 2 and not 13 <= len(digits) <= 19 or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            if kind == 0 and _BARE_AT.search(m[0]) and not _spelt_out(text, m):
                continue
            at = bisect.bisect_right(stops, m.start())
            if at == len(starts) or m.end() <= starts[at]:
                found.append((kind, m.start(), m.end()))
                starts.insert(at, m.start())
                stops.insert(at, m.end())
    return found


def votes(text: str, kind: int, start: int, stop: int) -> tuple[int, ...]:
    """What the labelers say: 1, 0 or -1 each."""
    span, digits = text[start:stop], _digits(text[start:stop])
    if kind == 0:
        joined = re.sub(r"\s+|[()\[\]{}]", "", re.sub(_DOT, ".", re.sub(_AT, "@", span, count=1, flags=re.I), flags=re.I))
        name, _, domain = joined.partition("@")
        ending = domain.rpartition(".")[2].lower()
        shape = 1 if "." in domain and 2 <= len(ending) <= 24 and ending.isalpha() and name else -1
        if "@" not in span and ending not in ENDINGS:  # two words of prose, more likely
            shape = -1
        gazetteer = 1 if ending in ENDINGS else -1
    elif kind == 1:
        parts = re.findall(r"[0-9]+", span)
        shape = 1 if len(parts) == 4 and all(map(_octet, parts)) and not any(len(p) > 1 and p[0] == "0" for p in parts) else -1
        gazetteer = -1 if shape < 0 or int(parts[0]) in (0, 255) or parts[1:] == ["0", "0", "0"] else 1
    elif kind == 2:
        shape = 1 if _card(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    else:
        bare = digits.removeprefix("00") if not span.startswith("+") else digits
        known = bare[:1] in CALLING or bare[:2] in CALLING or bare[:2] in ZONES
        groups = re.findall(r"[0-9]+", span)
        shape = 1 if span.startswith(("+", "00", "(")) or [len(g) for g in groups] == [3, 3, 4] else -1
        gazetteer = (1 if known else -1) if span.startswith(("+", "00")) else 0
    before = text[max(0, start - BEFORE) : start]
    context = -1 if COUNTER.search(before) else 1 if CUES[kind].search(before) else 0
    left, right = text[start - 1 : start], text[stop : stop + 1]
    border = -1 if left.isalnum() or right.isalnum() or left in ("=", "/", "#", "_") and left else 1
    look = 0 if kind in (0, 1) else -1 if len(set(digits)) < 4 or digits in "01234567890123456789" else 1
    return shape, gazetteer, context, border, look


def _code(kind: int, found: tuple[int, ...]) -> int:
    """Kind and votes as one small number."""
    for vote in found:
        kind = kind * 3 + vote + 1
    return kind


def _decode(code: int) -> tuple[int, list[int]]:
    own = []
    for _ in LABELERS:
        code, vote = divmod(code, 3)
        own.append(vote - 1)
    return code, own[::-1]


PATTERNS = len(KINDS) * 3 ** len(LABELERS)
SIGNS = 6  # bits of ``signs``


def signs(text: str, start: int, stop: int) -> int:
    """What the classifier sees beside the votes, one bit each.

    White space, brackets, and a capital inside; a colon, and a number, right before; a number right behind.
    """
    span, before, behind = text[start:stop], text[max(0, start - 3) : start], text[stop : stop + 3]
    own = any(map(str.isspace, span)), any(c in "()[]{}" for c in span), any("A" <= c <= "Z" for c in span)
    around = ":" in before, _DIGIT.search(before) is not None, _DIGIT.search(behind) is not None
    return sum(bit << i for i, bit in enumerate((*own, *around)))


@dataclass(frozen=True)
class SpanClassifier:
    """A logistic classifier of spans by kind, votes and signs, and the labelers' reliabilities by kind."""

    weights: tuple[float, ...]
    reliabilities: tuple[tuple[float, ...], ...]

    def accepts(self, patterns: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The probability of each pattern of votes with each set of signs."""
        return 1 / (1 + np.exp(-np.clip(_features(patterns, seen) @ np.array(self.weights), -30, 30)))


def _features(patterns: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Kinds, votes for and against, and the signs of each kind."""
    rows = np.zeros((len(patterns), len(KINDS) * (1 + SIGNS) + 2 * len(LABELERS)))
    for row, code, bits in zip(rows, np.asarray(patterns).tolist(), np.asarray(seen).tolist(), strict=True):
        kind, own = _decode(code)
        row[kind] = 1
        for i, vote in enumerate(own):
            if vote:
                row[len(KINDS) + 2 * i + (vote < 0)] = 1
        for i in range(SIGNS):
            row[len(KINDS) + 2 * len(LABELERS) + kind * SIGNS + i] = bits >> i & 1
    return rows


def estimate(counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern by expectation-maximisation, and each labeler's reliability by kind.

    ``counts`` has the number of spans of each pattern. The first guess is the
    majority; a prior worth eight spans holds reliabilities where there are few.
    """
    decoded = [_decode(code) for code in range(PATTERNS)]
    kinds = np.array([k for k, _ in decoded])
    own = np.array([v for _, v in decoded])
    posterior = 1 / (1 + np.exp(-1.5 * own.sum(axis=1)))
    reliability = np.zeros((len(KINDS), len(LABELERS)))
    prior = np.array([[0.1, 0.2, 0.7], [0.6, 0.3, 0.1]])  # votes -1, 0, 1 of a span that is data, and of one that is not
    for kind in range(len(KINDS)):
        at = np.flatnonzero(kinds == kind)
        n, q, v = counts[at].astype(float), posterior[at], own[at] + 1
        for _ in range(rounds):
            share = (n @ q + 4) / (n.sum() + 8)
            log_odds = np.full(len(at), np.log(share / (1 - share)))
            for labeler in range(len(LABELERS)):
                yes = np.array([n @ (q * (v[:, labeler] == x)) for x in range(3)]) + 8 * prior[0]
                no = np.array([n @ ((1 - q) * (v[:, labeler] == x)) for x in range(3)]) + 8 * prior[1]
                yes, no = yes / yes.sum(), no / no.sum()
                log_odds += np.log(yes[v[:, labeler]] / no[v[:, labeler]])
                reliability[kind, labeler] = share * yes[2] + (1 - share) * no[0]
            q = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        posterior[at] = q
    return posterior, reliability


def train(patterns: np.ndarray, seen: np.ndarray, counts: np.ndarray, posterior: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on patterns and signs, by their counts and the posteriors of all patterns."""
    # every pattern takes part a little, so that one not seen in this corpus is judged by its votes
    x = _features(np.concatenate((patterns, np.arange(PATTERNS))), np.concatenate((seen, np.zeros(PATTERNS, int))))
    n = np.concatenate((counts, np.full(PATTERNS, 0.01)))
    y = np.concatenate((posterior[patterns], posterior))
    weight = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge * weight
        curve = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(weight))
        step = np.linalg.solve(curve, slope)
        weight += step / max(1.0, np.abs(step).max() / 2)
    return weight


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("pattern", pa.int32()), ("signs", pa.int32())]))
SPANS = "array<struct<kind:int,start:int,stop:int,pattern:int,signs:int>>"


def _read(text: str) -> tuple[list[dict], list[dict]]:
    base = base_spans(text)
    rows = []
    for spans in (base, loose_spans(text, base)):
        rows.append([{"kind": k, "start": s, "stop": e, "pattern": _code(k, votes(text, k, s, e)), "signs": signs(text, s, e)} for k, s, e in spans])
    return rows[0], rows[1]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, loose``: spans with their patterns of votes and signs, one row per row of ``docs``.

    Null and empty texts have no spans; repeated rows get a row each; an empty table gives an empty result.
    """

    def work(batch):
        base, loose = zip(*map(_read, batch.column("text").to_pylist()), strict=True)
        return {"doc_id": batch.column("doc_id"), "base": pa.array(base, _SPANS), "loose": pa.array(loose, _SPANS)}

    return map_texts(texts(docs, doc_id, text), work, f"doc_id long, base {SPANS}, loose {SPANS}")


def _seen(base: str, loose: str, found: DataFrame) -> np.ndarray:
    """``pattern, signs, count`` of all spans: at most PATTERNS * 2**SIGNS rows, some hundreds in practice."""
    one = F.explode(F.concat(base, loose)).alias("span")
    rows = found.select(one).groupBy("span.pattern", "span.signs").count().collect()
    return np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, 3)


def fit(found: DataFrame, base: str = "base", loose: str = "loose") -> tuple[SpanClassifier, list[tuple[int, int]]]:
    """The classifier of ``candidates``, from the counts of all their patterns, and the patterns and signs that it accepts."""
    patterns, seen, n = _seen(base, loose, found).T
    posterior, reliability = estimate(np.bincount(patterns, weights=n, minlength=PATTERNS))
    model = SpanClassifier(tuple(train(patterns, seen, n.astype(float), posterior).tolist()), tuple(map(tuple, reliability.tolist())))
    taken = model.accepts(patterns, seen) >= ACCEPT
    return model, list(zip(patterns[taken].tolist(), seen[taken].tolist(), strict=True))


def _added(accepted: list[tuple[int, int]], loose: str):
    codes = [pattern << SIGNS | bits for pattern, bits in accepted]
    known = F.array(*[F.lit(c) for c in codes]) if codes else F.array().cast("array<int>")
    return F.filter(loose, lambda s: F.array_contains(known, F.shiftleft(s["pattern"], SIGNS) + s["signs"]))


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, added``: the base spans and the accepted candidates of every row.

    Starts and stops are code points. A null text is empty and has no span; texts
    are read whole; repeated rows get a row each; without any span in the corpus the
    classifier rests on its priors. An empty table gives an empty result.
    """
    found = stage(candidates(docs, doc_id, text), "candidates")
    return found.select("doc_id", "base", _added(fit(found)[1], "loose").alias("added"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all columns, base spans and accepted candidates in its texts replaced by ``[KIND]``.

    The texts are searched once: rows are staged with their spans, and what is replaced
    follows from these. Null texts stay null; repeated rows and columns of any name
    stay; where spans overlap, the one that begins first counts. An empty table gives an empty one.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    plain = docs.toDF(*names).withColumn("text", F.coalesce(names[at], F.lit("")))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in plain.drop("text").schema.fields]

    def work(batch):
        base, loose = zip(*map(_read, batch.column("text").to_pylist()), strict=True)
        return {name: batch.column(name) for name in names} | {"base": pa.array(base, _SPANS), "loose": pa.array(loose, _SPANS)}

    found = stage_packed(map_texts(plain, work, ", ".join([*fields, f"base {SPANS}", f"loose {SPANS}"])), "spans")
    spans = F.array_sort(F.transform(F.concat("base", _added(fit(found)[1], "loose")), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # text so far, and the place up to which it has been read
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    own = F.col(names[at])

    def step(held, s):
        between = F.substring(own, held["at"] + 1, s["start"] - held["at"])
        ahead = F.struct(F.concat(held["done"], between, F.element_at(marks, s["kind"] + 1)).alias("done"), s["stop"].alias("at"))
        inside = F.struct(held["done"].alias("done"), F.greatest(held["at"], s["stop"]).alias("at"))
        return F.when(s["start"] >= held["at"], ahead).otherwise(inside)

    replaced = F.aggregate(spans, begin, step, lambda held: F.concat(held["done"], F.substring(own, held["at"] + 1, F.length(own))))
    columns = [F.when((F.size("base") > 0) | (F.size("loose") > 0), replaced).otherwise(own) if i == at else F.col(n) for i, n in enumerate(names)]
    return found.select(*[c.alias(n) for c, n in zip(columns, docs.columns, strict=True)])


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of them, and all spans as text."""

    def listed(spans):
        return F.array_join(
            F.transform(
                F.array_sort(spans),
                lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")),
            ),
            ",",
        )

    def counted(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [counted(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
