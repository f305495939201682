"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.llm import chat, collocations, exact_dedup, language, packing, pii, ppm, quality, sentencepieces, simhash, token_file, toxicity, variants
from postlens.llm.common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out, threshold=0.7)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    return ppm.scores(table(spark, sf_dir, "documents"), learn)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, limit=3)


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_file_digest(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed_pieces(table(spark, sf_dir, "documents"), WORD_TOKENIZER, capacity=2048, end_id=0, with_ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.STRICT).alias("kept"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.formatted_digest(rows.unionByName(extra))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return language.languages(table(spark, sf_dir, "documents"), learn).select("doc_id", "held_out", "lang_pred", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, share=100, top=2000)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"), least_length=6, least=5, times=5, every=199)


_DEALT = (
    op1_toxicity, op2_sentencepiece, op3_ppm, op4_exact_dedup, op5_simhash, op6_token_file, op7_packing, op8_quality, op9_chat, op10_pii,
    op11_language, op12_collocations, op13_variants,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in _DEALT
}
SQL = {"op4_exact_dedup": exact_dedup.OP4_SQL, "op8_quality": quality.OP8_SQL, "op9_chat": chat.op9_sql(), "op12_collocations": collocations.op12_sql()}
