"""Dates, scores, hashes and check labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values
POSITIVE, NEGATIVE = "Positive", "Negative"
CORRECT, INCORRECT = "Correct", "Incorrect"


def day(ts: Column) -> Column:
    """The day of an instant in UTC, whatever the session's time zone."""
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))


def month_start(ts: Column) -> Column:
    return F.trunc(day(ts), "MM")


def utc_midnight(date) -> Column:
    """The instant at which a day (a ``datetime.date``) begins in UTC."""
    return F.to_timestamp(F.lit(f"{date.isoformat()} 00:00:00+00:00"), "yyyy-MM-dd HH:mm:ssXXX")


def polarity_label(score: Column) -> Column:
    """Neutral scores count as positive."""
    return F.when(score >= 0, POSITIVE).otherwise(NEGATIVE)


def round_half_even(value: Column, places: int = 2) -> Column:
    """Scale, round half to even, scale back; unlike ``round`` it works on the binary value."""
    scale = F.lit(float(10**places))
    return F.rint(value * scale) / scale


def unit_hash(seed: Column | str, key: Column) -> Column:
    """A number in (0, 1) that depends on ``seed`` and ``key`` only.

    Retried tasks and other engines draw the same number.
    """
    seed = F.lit(seed) if isinstance(seed, str) else seed
    digest = F.md5(F.concat(seed, F.lit(":"), key.cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return (number + 1.0) / F.lit(4294967297.0)


def prediction_check(actual: Column, predicted: Column) -> Column:
    return F.when(actual == predicted, CORRECT).otherwise(INCORRECT)


def outcome_check(actual: Column, predicted: Column, target: str) -> Column:
    """True/False for a right prediction, Positive/Negative for a prediction of ``target``."""
    return F.concat(
        F.when(actual == predicted, "True").otherwise("False"),
        F.lit("-"),
        F.when(predicted == F.lit(target), POSITIVE).otherwise(NEGATIVE),
    )
