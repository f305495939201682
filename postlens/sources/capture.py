"""Keyword captures out of an archive of posts."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from postlens.functions.scalars import day, utc_midnight
from postlens.schemas import RAW_POSTS, RAW_VALIDATION_POSTS


# Numbers of 64 bits in a post's signature.
LONGS = 8


def _between(start: datetime.date, until: datetime.date, language: str | None) -> Column:
    found = (F.col("date") >= utc_midnight(start)) & (F.col("date") < utc_midnight(until))
    return found if language is None else found & (F.col("lang") == language)


def _windows(start: datetime.date, end: datetime.date, clip_to_end: bool) -> tuple[Column, datetime.date]:
    """The month window of a post, and the day on which captures end."""
    if start.day != 1:
        raise ValueError("the first window has to start on the first of a month")
    after = end.month % 12 + 1
    until = datetime.date(end.year + (after == 1), after, 1)
    return F.trunc(day(F.col("date")), "MM"), end + datetime.timedelta(days=1) if clip_to_end else until


def capture_monthly(
    archive: DataFrame,
    keyword: str,
    start: datetime.date,
    end: datetime.date,
    language: str = "en",
    clip_to_end: bool = False,
) -> DataFrame:
    """Posts with ``keyword`` from ``start`` on, with the month window each belongs to.

    Windows are whole months from ``start``, the first of a month, while they
    begin no later than ``end``; the last one therefore runs past ``end`` unless
    it is clipped. Appends ``window_start`` and ``window_end`` (exclusive), and the
    name of the ``capture``: posts that two captures find stay apart by it.
    """
    window, until = _windows(start, end, clip_to_end)
    found = archive.filter(_between(start, until, language) & F.lower("content").contains(keyword.lower()))
    return found.select(
        *RAW_POSTS.fieldNames(),
        F.concat(F.lit(f"{keyword}/{language}/"), window.cast("string")).alias("capture"),
        window.alias("window_start"),
        F.least(F.add_months(window, 1), F.lit(until)).alias("window_end"),
    )


def trigram_slots(text: str, longs: int = LONGS) -> list[int]:
    """A keyword's signature: one bit for each of its runs of three characters, in ``longs`` signed numbers.

    The slot of a run is the polynomial of its code points that ``with_signature`` works out.
    """
    own, points = [0] * longs, [ord(c) for c in text.lower()]
    for a, b, c in zip(points, points[1:], points[2:]):  # noqa: B905
        slot = (a * 961 + b * 31 + c) % (64 * longs)
        own[slot // 64] |= 1 << slot % 64
    return [x - (1 << 64) if x >> 63 else x for x in own]


def with_signature(archive: DataFrame, longs: int = LONGS) -> DataFrame:
    """``archive`` with ``signature``: one bit for each run of three characters of the lower-case content.

    Worked out once, when the archive is stored; ``capture_keywords`` reads it instead of the
    content where it can tell that a keyword is not there.
    """
    points = F.transform(F.filter(F.split(F.lower(F.coalesce("content", F.lit(""))), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    size = F.greatest(F.size("_points") - 2, F.lit(0))
    third = F.zip_with(F.slice("_points", F.lit(1), size), F.slice("_points", F.lit(2), size), lambda a, b: a * 961 + b * 31)
    slots = F.array_distinct(F.zip_with(third, F.slice("_points", F.lit(3), size), lambda a, c: F.pmod(a + c, F.lit(64 * longs))))

    def number(i: int) -> Column:
        own = F.filter("_slots", lambda s: F.floor(s / 64) == i)
        return F.aggregate(own, F.lit(0).cast("long"), lambda bits, s: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(s, F.lit(64)).cast("int"))))

    marked = archive.withColumn("_points", points).withColumn("_slots", slots)
    return marked.withColumn("signature", F.array(*[number(i) for i in range(longs)])).drop("_points", "_slots")


def capture_keywords(
    archive: DataFrame,
    keywords: list[str],
    start: datetime.date,
    end: datetime.date,
    language: str = "en",
    clip_to_end: bool = False,
    longs: int = LONGS,
) -> DataFrame:
    """``capture_monthly`` of all ``keywords`` in one scan: one row for each post and keyword, with the ``keyword``.

    If the archive has a ``signature``, a keyword is only looked for in posts whose bits include
    all of its own; what it lets through is tested as before, so it changes no row. Keywords
    of fewer than three characters have no bits. Repeated keywords count once.
    """
    window, until = _windows(start, end, clip_to_end)
    signed = "signature" in archive.columns
    listed = []
    for keyword in dict.fromkeys(keywords):
        bits = trigram_slots(keyword, longs) if signed else []
        listed.append(F.struct(F.lit(keyword).alias("keyword"), F.lit(keyword.lower()).alias("small"), F.array(*[F.lit(x).cast("long") for x in bits]).alias("bits")))
    if not listed:
        raise ValueError("no keyword")

    def hit(k: Column) -> Column:
        found = F.col("_small").contains(k["small"])
        if not signed:
            return found
        # the numbers one after the other: most posts fail at the first
        for i in reversed(range(longs)):
            found = (F.col("signature")[i].bitwiseAND(k["bits"][i]) == k["bits"][i]) & found
        return found

    rows = archive.filter(_between(start, until, language)).withColumn("_small", F.lower("content"))
    hits = rows.withColumn("_hit", F.explode(F.filter(F.array(*listed), hit)))
    return hits.select(
        F.col("_hit.keyword").alias("keyword"),
        *RAW_POSTS.fieldNames(),
        F.concat("_hit.keyword", F.lit(f"/{language}/"), window.cast("string")).alias("capture"),
        window.alias("window_start"),
        F.least(F.add_months(window, 1), F.lit(until)).alias("window_end"),
    )


def write_capture(captured: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Parquet, one sub-folder per month window, in files of even size."""
    rows = captured.drop("window_end").hint("rebalance", "window_start")
    rows.write.mode(mode).partitionBy("window_start").parquet(folder)


def capture_window(
    archive: DataFrame, keyword: str, start: datetime.date, end: datetime.date, language: str | None = "en"
) -> DataFrame:
    """Posts with ``keyword`` from ``start`` up to, but not on, ``end``, with their address.

    Without a ``language`` those of all languages count.
    """
    found = _between(start, end, language) & F.lower("content").contains(keyword.lower())
    return archive.filter(found).select(*RAW_VALIDATION_POSTS.fieldNames())
