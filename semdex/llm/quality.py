"""Operator 9: quality classifier.

Logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as a sparse dot
product. The n-grams are words and word pairs, and the shapes of words (letter
case, digits and punctuation, runs shortened) singly and in pairs, so words that
no training document holds still count. A document's value is the mean weight of
its n-grams of each family, over the whole text.

Training reads a bounded sample of labelled rows (`sample_rows`, by a hash of the
identifier) in one task and returns `2**bits` weights, a fixed size, which are
broadcast for scoring.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import pack
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.llm._common import table

BITS = 18
SAMPLE_ROWS = 8_000
EPOCHS = 2
THRESHOLD = 0.3
FAMILIES = 4
SCALE = 6.0             # a family's mean is multiplied by it, so that weights stay small
MEMO_WORDS = 200_000

_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c
               for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


class _Memo(dict):
    """Word -> its hash and the hash of its shape, four bytes each."""

    def __missing__(self, w: bytes) -> bytes:
        found = pack("<II", crc32(w), crc32(_RUN.sub(rb"\1", w.translate(_SHAPE)), 7))
        if len(self) < MEMO_WORDS:      # frequent words come early: a full memo stays as it is
            self[w] = found
        return found


class Hasher:
    """Text -> n-gram slots per family. Keeps the hashes of words it has met."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint32((1 << bits) - 1)
        self.memo = _Memo()

    def slots(self, text: str | None) -> list[np.ndarray]:
        # bytes.split() splits at the ASCII white space that separates words
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        if not words:
            return []
        both = np.frombuffer(b"".join(map(self.memo.__getitem__, words)), "<u4").reshape(-1, 2)
        out = []
        for family in (0, 1):
            h = np.ascontiguousarray(both[:, family])
            two = (h[:-1] * np.uint32(0x9E3779B1) + np.uint32(family + 1)) ^ (h[1:] * np.uint32(0x85EBCA6B))
            if family == 0:     # a word next to itself is one n-gram, whatever the word
                two[h[:-1] == h[1:]] = np.uint32(0x27D4EB2F)
            out += [h, two]
        return [((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(i * 0x51ED27)) >> np.uint32(5) & self.mask
                for i, h in enumerate(out) if len(h)]


def _sigmoid(v: np.ndarray | float):
    return 1.0 / (1.0 + np.exp(-np.clip(v, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels, size: int, epochs: int, alpha: float,
         beta: float, l1: float, l2: float) -> np.ndarray:
    """FTRL-proximal logistic regression over sparse rows (slots, values), one
    update a row, in the given order. A slot may repeat within a row."""
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for (at, x), y in zip(rows, labels):
            g = (_sigmoid(w[at] @ x) - y) * x
            before = n[at]
            np.add.at(n, at, g * g)
            sigma = (np.sqrt(n[at]) - np.sqrt(before)) / alpha
            np.add.at(z, at, g - sigma * w[at])
            zz = z[at]
            w[at] = np.where(np.abs(zz) <= l1, 0.0,
                             -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
    return w.astype(np.float32)


def train_ftrl(texts, labels, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last."""
    hasher, size = Hasher(bits), (1 << bits) + 1
    rows = []
    for t in texts:
        slots, values = [np.array([size - 1])], [np.ones(1)]
        for h in hasher.slots(t):
            at, count = np.unique(h, return_counts=True)
            slots.append(at)
            values.append(count * (SCALE / len(h)))
        rows.append((np.concatenate(slots).astype(np.int32), np.concatenate(values).astype(np.float32)))
    return ftrl(rows, labels, size, epochs, alpha=0.4, beta=1.0, l1=0.02, l2=0.02)


def score_text(text: str | None, weights: np.ndarray, hasher: Hasher) -> float:
    value = float(weights[-1])
    for h in hasher.slots(text):
        value += SCALE * float(weights[h].mean())
    return float(_sigmoid(value))


def held_out(doc_id: Column, of: int, rest: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of)) == rest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, of: int, rest: int, rows: int) -> DataFrame:
    """(text, y) of at most `rows` labelled documents outside the held-out fold.

    Rows are chosen by a hash of the identifier, so reruns agree; where labels of
    an identifier differ the smaller one counts, null labels and identifiers are
    left out. The chosen identifiers are a bounded table and are broadcast. Of
    rows that repeat an identifier the one with the smallest text hash counts.
    """
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), of, rest))
              .groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
              .withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(rows))
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "at", "y").agg(first.alias("text")).select("at", "text", "y"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", of: int = 5, rest: int = 0,
        sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights learned from the bounded sample, in one task of an executor; all 0 without labelled rows."""
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(batches))
        whole = whole.sort_values(["at", "text"], kind="stable")
        yield pd.DataFrame({"w": [train_ftrl(whole["text"], whole["y"].to_numpy(dtype=float), bits).tobytes()]})

    sample = labelled_sample(docs, labels, label, of, rest, sample_rows)
    row = sample.repartition(1).mapInPandas(learn, "w binary").first()
    return np.zeros((1 << bits) + 1, np.float32) if row is None else np.frombuffer(row["w"], dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with `score_col`: 0 to 1, higher: label 1 likelier.

    Whole texts are scored; null and blank texts get the score of the bias alone.
    An existing column of that name is replaced; every other column and every
    repeated row stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(int(len(shared.value) - 1).bit_length() - 1)
        for part in parts:
            yield pd.Series([score_text(t, shared.value, hasher) for t in part], dtype="float64")

    return docs.withColumn(score_col, scored(F.col(f"`{text_col}`")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, weights).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier accepts."""
    weights = fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return score(rows, weights).where(F.col("score") >= THRESHOLD).select("row.*")
