"""Parsing of the stringified mention and hashtag lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# One user's part of the text runs up to where the next one begins.
USER = r"(?s)username='.*?(?=username='|\z)"
USERNAME = r"^username='(.*?)'"
# Names are taken between their own quotes, so commas and apostrophes stay.
DISPLAY_NAME = r"displayname=(['\"])(.*?)\1,"
LIST_PUNCTUATION = r"[,\[\]']"

# A list as its text form has it: items in either quotes, with backslash escapes.
ITEM = r"(?:'(?:[^'\\]++|\\.)*+'|\"(?:[^\"\\]++|\\.)*+\")"
LIST = rf"^\s*\[\s*(?:{ITEM}(?:\s*,\s*{ITEM})*+\s*,?)?\s*\]\s*$"
ESCAPE = r"\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"
# What a letter after a backslash stands for.
CONTROLS = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def _users(users: Column) -> Column:
    return F.regexp_extract_all(users, F.lit(USER), F.lit(0))


def mention_usernames(users: Column) -> Column:
    return F.transform(_users(users), lambda user: F.regexp_extract(user, USERNAME, 1))


def mention_display_names(users: Column) -> Column:
    """One name for each user name; null where it is not in quotes."""
    return F.transform(
        _users(users),
        lambda user: F.when(user.rlike(DISPLAY_NAME), F.regexp_extract(user, DISPLAY_NAME, 2)),
    )


def readable_list(tags: Column) -> Column:
    """Whether the text is a list as ``hashtag_array`` reads it; a null one is."""
    return F.coalesce(tags.rlike(LIST), F.lit(True))


def hashtag_array(tags: Column) -> Column:
    """The items of a list in text form, all its string escapes resolved; null if it is no list."""
    quoted = F.regexp_extract_all(tags, F.lit(ITEM), F.lit(0))
    items = F.transform(quoted, lambda item: F.substring(item, F.lit(2), F.length(item) - 2))
    return F.when(tags.rlike(LIST), F.transform(items, lambda item: F.when(item.contains("\\"), _unescaped(item)).otherwise(item)))


def _unescaped(item: Column) -> Column:
    def resolved(part: Column) -> Column:
        code = F.lpad(F.substring(part, 3, 8), 8, "0")
        character = F.decode(F.unhex(code), "UTF-32")
        out = F.when(part.rlike(r"^\\[xuU][0-9A-Fa-f]{2,8}$"), character)
        for letter, meant in CONTROLS.items():
            out = out.when(part == "\\" + letter, meant)
        return out.when(part.startswith("\\"), F.substring(part, 2, 1)).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(item, F.lit(ESCAPE), F.lit(0)), resolved), "")


def joined(values: Column) -> Column:
    """A list as one space-separated string without list punctuation."""
    return F.array_join(F.transform(values, lambda v: F.regexp_replace(v, LIST_PUNCTUATION, "")), " ")


def joined_lower(values: Column) -> Column:
    return F.lower(joined(values))


def tag_label(tag: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(tag))
