"""Small tables with the odd cases that every operator meets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n: int, step: int = 7, start: int = 0) -> str:
    """n words that don't repeat in windows for long."""
    return " ".join(f"{WORDS[(start + i * step) % 20]}{(start + i) * 31 % 97}" for i in range(n))


def odd_rows() -> list[tuple]:
    base = prose(120)
    return [
        (1, base, "a"), (2, base, "b"), (2, base, "b"), (3, None, "a"), (4, "", None), (5, " \t\n\x0b\x0c\r", "a"),
        (None, base, "a"), (None, None, None), (6, base.replace("alpha0 ", "other "), "a"), (7, base.upper(), "c"),
        (8, "one", "c"), (9, "one", "c"), (10, "one two three", "a"), (11, prose(6000, 3), "a"), (12, "é à ü 日本語 ​x", "b"),
        (13, "spam " * 300, "a"), (14, base + " tail", "a"), (15, "x" * 5000, "a"), (16, "<|endoftext|> a<|endoftext|>b", "b"),
    ]


def odd(spark: SparkSession) -> DataFrame:
    """The odd rows, with extra columns whose names operators use inside."""
    rows = [(i, t, "en", s, 0, 1, b"k", "n", 7, 0.5) for i, t, s in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, key binary, name string, "
                                       "row_ long, score double").repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return odd(spark).where("false")


def labels(spark: SparkSession, rows=((1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 1, 1), (99, 0, 0), (3, None, None))) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
