"""Embeddings kept between runs (V5).

A store is a Parquet folder (lang, text, vec), partitioned by language, that belongs
to one encoder. A run encodes only those distinct texts that the store lacks
(an anti-join), appends them, and joins the stored vectors to its rows. An append
that fails leaves nothing behind; two runs at the same time may store a text twice,
and readers take one of the equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.operators.encode import MAX_TOKENS, encode_texts

SCHEMA = "lang string, text string, vec array<double>"


def stored_vectors(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(text, vec) of one language, one row a text; a store that isn't there yet is made, empty."""
    spark.createDataFrame([], SCHEMA).write.mode("ignore").partitionBy("lang").parquet(path)
    held = spark.read.schema(SCHEMA).parquet(path).where(F.col("lang") == lang)
    return held.select("text", "vec").dropDuplicates(["text"])


def missing_texts(texts: DataFrame, text_col: str, path: str, lang: str) -> DataFrame:
    """(text): the distinct texts that the store lacks."""
    asked = texts.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    return asked.join(stored_vectors(texts.sparkSession, path, lang).select("text"), "text", "left_anti")


def encode_stored(texts: DataFrame, text_col: str, path: str, word_vectors: DataFrame, dim: int, lang: str = "pt",
                  out: str = "vec", encoder: Callable | dict | None = None, max_tokens: int | None = MAX_TOKENS) -> DataFrame:
    """``encode_texts`` through the store at ``path``: adds ``out``; a null text has the zero vector."""
    new = encode_texts(missing_texts(texts, text_col, path, lang), "text", word_vectors, dim, key=["text"],
                       encoder=encoder, lang=lang, max_tokens=max_tokens)
    (new.select(F.lit(lang).alias("lang"), "text", "vec").write.mode("append").partitionBy("lang").parquet(path))
    held = stored_vectors(texts.sparkSession, path, lang).select(F.col("text").alias(text_col), F.col("vec").alias(out))
    return texts.join(held, text_col, "left").withColumn(
        out, F.coalesce(F.col(out), F.array_repeat(F.lit(0.0).cast("double"), dim)))
