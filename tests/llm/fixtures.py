"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node bigint, kept boolean"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(spark: SparkSession, parts: int = 3) -> DataFrame:
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.split()
    near[7] = "other"
    far = words(rng, 120)
    texts = [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (4, far), (5, ""), (6, None), (None, base), (7, words(rng, 6000)), (8, "one two three"),
        (9, "One  two\tthree"), (10, "### !!! *** ### ### !!!"), (11, "\n".join(["the same line again"] * 40)), (12, far + "\n" + far), (13, "   \n\t "),
        (14, "naïve Überraschung “quoted” 日本語 <|endoftext|> İstanbul it's 3½"), (15, base.upper() + "!!"),
    ]
    rows = [(i, t, ("en", "fr", None)[k % 3], ("a", None, "b", "a")[k % 4], None if t is None else len(t), 0.5, 1, False) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    w = lower_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
