"""Text cleaning, tokens and n-grams as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlens.functions.stopwords import ENGLISH

# Unicode word and non-space characters, spelled out because the engines'
# own \w and \S are ASCII-only.
WORD = r"[\p{L}\p{N}_]"
NON_SPACE = r"[^\s\p{Z}\x0B\x1C-\x1F\x85]"

# The markup that is deleted, in this order.
AMPERSAND = "&amp;"
LINK = f"http{NON_SPACE}+"
# A run of non-space characters holding ".com" inside goes as a whole, so it is
# enough to try each run from its first character: linear on long runs.
DOT_COM = rf"(?<!{NON_SPACE}){NON_SPACE}+?\.com{NON_SPACE}+"
MENTION = f"@{WORD}+"
HASHTAG = f"#{WORD}+"

# Words the tokenizer splits in two (cannot -> can not).
SPLIT_WORDS = r"\b(can(?=not\b)|gim(?=me\b)|gon(?=na\b)|got(?=ta\b)|lem(?=me\b)|wan(?=na\b))"

TERM = f"{WORD}{{2,}}"


def strip_markup(text: Column) -> Column:
    """Delete entities, links, mentions and hashtags; a null text counts as blank."""
    text = F.coalesce(text, F.lit(""))
    out = F.regexp_replace(F.replace(text, F.lit(AMPERSAND), F.lit("")), LINK, "")
    # the costly pattern is only tried where ".com" is, or may have come together
    may_hold = text.contains(".com") | text.contains(AMPERSAND)
    out = F.when(may_hold, F.regexp_replace(out, DOT_COM, "")).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(out, MENTION, ""), HASHTAG, "")
    # nothing of the above can be in a text without one of these
    plain = F.lit(True)
    for sign in (AMPERSAND, "http", ".com", "@", "#"):
        plain = plain & ~text.contains(sign)
    return F.when(plain, text).otherwise(out)


def clean_words(text: Column) -> Column:
    """The lower-case ASCII words of ``text`` without markup and stopwords, in order."""
    letters = F.regexp_replace(F.lower(strip_markup(text)), "[^A-Za-z]+", " ")
    words = F.split(F.regexp_replace(letters, SPLIT_WORDS, "$1 "), " ")
    # a literal list becomes a hash-set lookup, so the list length does not matter
    return F.filter(words, lambda word: ~word.isin(["", *ENGLISH]))


def clean_text(text: Column) -> Column:
    return F.array_join(clean_words(text), " ")


def terms(text: Column) -> Column:
    """Lower-case terms of two or more word characters, as the vectorisers see them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array, for n = 1, 2, 3, ...

    Each step pairs the (n-1)-grams with the tokens that follow them; the slices
    are empty for short arrays, so no guard is needed.
    """
    grams = tokens
    for size in range(2, n + 1):
        length = F.greatest(F.size(tokens) - F.lit(size - 1), F.lit(0))
        grams = F.zip_with(
            F.slice(grams, F.lit(1), length),
            F.slice(tokens, F.lit(size), length),
            lambda head, tail: F.concat(head, F.lit(" "), tail),
        )
    return grams
