"""Quality rules as a ledger of failure bits.

All rules are evaluated once, with column expressions only. The ledger keeps for
each document the measurements and one long whose bit k says that rule k failed.
Policies are versioned sets of rules; applying one, comparing several, or asking
what a rule contributes needs the bits alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` is the rule's place for good."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of the rules that reject."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        known = {r.name: r.bit for r in RULES}
        return sum(1 << known[r] for r in self.rules)


# Rules are only ever added; a retired rule keeps its bit.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words)"),
    Rule(3, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(4, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(5, "few_letters", "10 * n_letters < 5 * word_chars"),
    Rule(6, "capitals", "2 * n_capitals > n_letters"),
)
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))
MEASUREMENTS = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_letters n_capitals".split()


def measurements(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` in a struct ``doc``, and the measurements of the whole text.

    Two windows count as equal if their 64-bit hashes are and then, in the texts
    where that happens at all, if the words are: the count is exact.
    """
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.select(F.struct("*").alias("doc"), own.alias("text"))
    found = found.select(
        "*",
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(NOT_SPACE)).alias("lines"),
    )
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    found = found.withColumn("hashes", hashes)
    windows = F.transform("hashes", lambda _, i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("window"), i.alias("at")))
    found = found.withColumn(
        "ordered", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(windows))
    )

    def repeated(x: Column, j: Column) -> Column:
        return (F.get("ordered", j - 1)["window"] == x["window"]) | (F.get("ordered", j + 1)["window"] == x["window"])

    found = found.withColumn("places", F.array_sort(F.transform(F.filter("ordered", repeated), lambda x: x["at"])))
    # a window covers its words up to the next window's start
    covered = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    measured = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("text", "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("text", "[^\\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    )
    # as a generator of one row: a filter on the results is not moved below it, where it would repeat their expressions
    return found.select("doc", F.inline(F.array(measured)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its columns in ``doc``, the measurements, and ``failures``.

    A null text counts as empty: no words, so that it fails ``few_words``. Texts
    of any length are read whole; repeated rows get a row each; an empty table
    gives an empty ledger; columns of ``docs`` cannot clash, they stay in ``doc``.
    """
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0)).cast("long")
    return measurements(docs, text).withColumn("failures", bits)


def passes(policy: Policy) -> Column:
    """Whether a ledger's row passes ``policy``."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0


def keep(docs: DataFrame, policy: Policy = STRICT, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass ``policy``."""
    return ledger(docs, text).where(passes(policy)).select("doc.*")


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = (BASE, STRICT)) -> DataFrame:
    """What each rule contributes to each policy, from a ledger.

    ``policy, version, rule, rejected`` (by the policy), ``failed`` (the rule, within
    the policy), ``alone`` (documents that only this rule rejects: the policy
    without it would keep them), ``overlap`` (the bits that all documents failing
    the rule share) and ``company`` (the bits that any of them has). The ledger is first counted
    by its failure bits, of which there are at most two to the number of rules.
    """
    counts = entries.groupBy("failures").agg(F.count("*").alias("n"))
    known = {r.name: r.bit for r in RULES}
    cells = F.array(
        *[
            F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(1 << known[r]).cast("long").alias("bit"))
            for p in policies
            for r in p.rules
        ]
    )
    rows = counts.select("failures", "n", F.inline(cells))
    hit, own = F.col("failures").bitwiseAND(F.col("mask")), F.col("failures").bitwiseAND(F.col("bit"))
    return rows.groupBy("policy", "version", "rule").agg(
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(own != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("alone"),
        F.coalesce(F.bit_and(F.when(own != 0, hit)), F.lit(0)).alias("overlap"),
        F.coalesce(F.bit_or(F.when(own != 0, hit)), F.lit(0)).alias("company"),
    )


OP8_SQL = """
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
w as (select doc_id, r, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
g as (select r, i, concat_ws(' ', words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) as win
  from (select r, words, unnest(range(1, len(words) - 3)) as i from w)),
p as (select r, i from (select r, i, count(*) over (partition by r, win) as c from g) where c > 1),
c as (select r, sum(least(5, coalesce(nxt - i, 5))) as n
  from (select r, i, lead(i) over (partition by r order by i) as nxt from p) group by r),
m as (select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) as n_symbols, len(lines) as n_lines,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
  length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) as n_letters, length(regexp_replace(text, '[^\\p{Lu}]+', '', 'g')) as n_capitals
  from w left join c using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, cast(n_words as bigint) as n_words, word_chars, n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or (n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words)) or 10 * n_symbols > 3 * n_words
    or 10 * n_dup_lines > 3 * n_lines or 10 * n_letters < 5 * word_chars or 2 * n_capitals > n_letters) as kept
from b
"""
