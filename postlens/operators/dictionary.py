"""Per-row sums over a token array of the weights that a small dictionary gives its words."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F

from postlens import runtime


def word_sums(
    df: DataFrame,
    tokens: Column,
    dictionary: DataFrame,
    word: str,
    weights: list[str],
    max_rows: int | None = None,
) -> DataFrame:
    """Append, for each long column in ``weights``, its sum over the matched tokens.

    A token counts as often as it occurs; rows without a match get 0. ``word``
    must be unique in ``dictionary``, and the new columns carry the weights' names.

    Up to ``max_rows`` words the sums are computed inside each row, so nothing is
    shuffled. A longer dictionary is joined to the exploded tokens.
    """
    limit = runtime.DICTIONARY_ROWS if max_rows is None else max_rows
    entries = dictionary.select(word, *weights).filter(F.col(word).isNotNull()).limit(limit + 1).collect()
    if len(entries) > limit:
        return _joined_sums(df, tokens, dictionary, word, weights)
    if not entries:
        return df.withColumns({name: F.lit(0).cast("long") for name in weights})
    return _row_local_sums(df, tokens, entries, word, weights)


def _row_local_sums(df, tokens, entries, word, weights):
    counter = CountVectorizerModel.from_vocabulary(
        [entry[word] for entry in entries], inputCol="_tokens", outputCol="_hits"
    )
    counted = counter.transform(df.withColumn("_tokens", tokens))
    # the sparse vector holds the matched dictionary positions and their counts
    hits = F.unwrap_udt("_hits")

    def total(name: str) -> Column:
        table = F.split(F.lit(",".join(str(int(entry[name])) for entry in entries)), ",").cast("array<bigint>")
        products = F.zip_with(hits["indices"], hits["values"], lambda i, n: F.get(table, i) * n.cast("long"))
        return F.aggregate(products, F.lit(0).cast("long"), lambda acc, x: acc + x)

    sums = {name: total(name) for name in weights}
    return counted.withColumns(sums).drop("_tokens", "_hits")


def _joined_sums(df, tokens, dictionary, word, weights, limit=None):
    # rows may repeat, so each gets its own number
    rows = runtime.number_rows(df.withColumn("_tokens", tokens), "_row", "dictionary-rows")
    counts = (
        rows.select("_row", F.explode("_tokens").alias(word))
        .groupBy("_row", word)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    entries = dictionary.select(word, *weights).filter(F.col(word).isNotNull())
    if not runtime.fits_broadcast(entries, limit):
        counts = runtime.stage(counts, "dictionary-words")  # read more than once below
    sums = (
        runtime.join_spread(counts, entries, [word], limit)
        .groupBy("_row")
        .agg(*[F.sum(F.col(name) * F.col("_n")).alias(name) for name in weights])
    )
    return (
        rows.join(sums, "_row", "left")
        .withColumns({name: F.coalesce(F.col(name), F.lit(0).cast("long")) for name in weights})
        .drop("_tokens", "_row")
    )
