"""Token ids of whole texts with a word-based tokenizer file."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable

from tokenizers import Tokenizer

from postlens.llm.common import worker_state

# Words kept with their ids, and runs of letters; as many again from before, so that what is common survives.
REMEMBERED = 300_000
# Words of ASCII signs and Latin letters fall apart into runs of letters, single digits and runs of the rest. Left out:
# the apostrophe, which begins parts of its own, the bar of special tokens, and the dotted capital I, whose
# lower case is two characters.
_LETTERS = "a-zß-öø-įı-ž"
_PLAIN = re.compile("[!-&(-{}~À-ÖØ-öø-įı-ž]+")
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")
_RUN = re.compile(f"[{_LETTERS}]+")


def byte_signs() -> dict[int, int]:
    """The signs by which byte-level vocabularies spell bytes, for ``str.translate`` of Latin-1 text."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


class Remembered(dict):
    """Values by key, worked out when first asked for. Two generations: what is asked for stays, the rest goes in time."""

    def __init__(self, find: Callable):
        super().__init__()
        self.find, self.before = find, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.find(key)
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class WordIds:
    """Ids (little-endian uint32 bytes) by word. The tokenizer drops white space and never joins across it.

    Most rare words are known runs of letters with other punctuation or capitals, so
    a new word is put together from its parts, and a run of letters goes to the
    vocabulary's merges at once.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge, self.signs = tokenizer.encode, tokenizer.model.tokenize, byte_signs()
        self.words, self.parts = Remembered(self._word), Remembered(self._part)
        self.known = self.words.__getitem__

    def _whole(self, word: str) -> bytes:
        return _little(self.encode(word, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        """Of a run of letters in lower case, or of what stands between such runs."""
        if not _RUN.fullmatch(part):
            return self._whole(part)
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.signs)
        return _little([t.id for t in self.merge(spelt)])

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes: A-Z and a-z only
            return self.parts[word.decode().lower()]
        if word[-1] in b".,;:!?" and word[:-1].isalpha():
            return self.parts[word[:-1].decode().lower()] + self.parts[chr(word[-1])]
        text = word.decode()
        if _PLAIN.fullmatch(text):
            return b"".join([self.parts[part] for part in _PARTS.findall(text.lower())])
        return self._whole(text)

    def text(self, text: bytes) -> bytes:
        """Ids of a text in UTF-8; bytes.split() takes the tokenizer's white space, x20 and x09-x0D."""
        return b"".join(map(self.known, text.split()))


def _little(ids: list[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


def splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer file is of the kind that ``WordIds`` may take word by word."""
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") for s in steps) and not any(
        t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])
    )


def word_ids(path: str) -> WordIds:
    """The table of a file, kept by the Python worker."""
    if not splits_at_spaces(path):
        raise ValueError(f"{path}: not a tokenizer whose pre-tokenizer drops white space")
    return worker_state(f"words:{path}", lambda: WordIds(path))
