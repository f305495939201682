"""Small tables that every operator has to take."""

from pyspark.sql import DataFrame, SparkSession

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, block string, row string, fingerprint string"
LONG = " ".join(f"word{i % 977} of the {i}th line," for i in range(30_000))


def edge_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, odd characters, a null id."""
    plain = "The quick brown fox jumps over the lazy dog. It was not amused, and said so at some length."
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, plain), (5, plain), (5, plain), (6, plain.upper()), (None, plain), (None, None),
        (7, LONG), (8, LONG + " x"), (9, "é̀ ﬁ \U0001f600   naïve ß İ \x00 \x85 Σας"), (10, "a b c d e f g h i j k l"),
        (11, "one"), (12, "+1 (017) 555-7713 me.9@mail4.example.com 10.1.2.3"), (13, "<s>[INST] <\\s> </s> \\"),
    ]


def edges(spark: SparkSession) -> DataFrame:
    """The rows above with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, None, True, "b", "r", "f") for i, t in edge_texts()], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def of(spark: SparkSession, found: list[str | None]) -> DataFrame:
    """Texts with ids from 0."""
    return spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
