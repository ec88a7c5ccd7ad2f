"""Operator 11: language identification by error-correcting output codes.

Every language has a codeword, a row of signs. For each column of the code a binary
classifier over hashed character n-grams predicts that sign: the values of all
columns are one product of a text's n-gram frequencies with a weight matrix. A
codeword's distance is the sum of the logistic losses of its signs, each weighted by
how reliable its classifier was on sampled rows that it had not learned from; the
nearest codeword names the language, so a few wrong signs do no harm. Where the next
one is nearly as near, the row is flagged as ambiguous.

Up to five languages have the exhaustive code (all ways to part them in two), more
have the rows of a Sylvester-Hadamard matrix without its constant column, in which
any two differ in half of the columns.

Learning reads a bounded sample, `per_language` rows of each of at most `languages`
languages, by a hash of identifier and text, in one task of an executor, and returns
a matrix of fixed size, which is broadcast for scoring.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semdex.llm._common import materialize, table
from semdex.llm.quality import held_out

PER_LANGUAGE = 1000         # sampled rows of a language
LANGUAGES = 256             # the most frequent ones are learned
SLOT_BITS = (9, 13, 15)     # slots of single characters, pairs and triples
EPOCHS = 3
RATE = 0.5
SCALE = 8.0                 # n-gram frequencies are multiplied by it
SNIPPETS = (1, 3, 8, 25)    # words of a part of each sampled text that is learned besides the whole
AMBIGUOUS = 0.5             # losses that differ by less, a weighted sign's worth, are ambiguous
CHUNK = 1 << 20             # characters hashed at a time
UNKNOWN = "und"

_SPACE = 32
_START = np.cumsum([0, *(1 << b for b in SLOT_BITS)])
SLOTS = int(_START[-1])
_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else a blank."""
    global _table
    if _table is None:
        _table = np.full(0x110000, _SPACE, np.uint32)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                _table[ord(c)] = ord(c.lower()[0])
    return _table


def frequencies(text: str) -> np.ndarray:
    """Relative frequencies of the hashed character n-grams of a whole text, blanks standing for
    whatever is no letter; all 0 without letters. Long texts are hashed in parts that overlap."""
    count = [np.zeros(1 << b) for b in SLOT_BITS]
    letters, last = _letters(), np.array([], np.uint32)
    for at in range(0, max(len(text), 1), CHUNK):
        codes = letters[np.frombuffer(text[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = [[_SPACE]] * (at == 0), [[_SPACE]] * (at + CHUNK >= len(text))
        codes = np.concatenate([last, *ends[0], codes, *ends[1]]).astype(np.uint32)
        fresh = len(last)
        blank = codes == _SPACE
        keep = ~(blank & np.concatenate([[False], blank[:-1]]))
        codes, fresh = codes[keep], int(keep[:fresh].sum())     # the first ones were counted before
        two = codes[:-1] * np.uint32(0x9E3779B1) ^ codes[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) ^ codes[2:] * np.uint32(0x27D4EB2F)
        for i, h in enumerate((codes * np.uint32(0x2C1B3C6D), two, three)):
            new = h[max(0, fresh - i):]
            if i == 0:
                new = new[codes[fresh:] != _SPACE]
            h = new * np.uint32(0x9E3779B1)
            count[i] += np.bincount((h ^ (h >> np.uint32(15))) >> np.uint32(32 - 1 - SLOT_BITS[i]) & np.uint32((1 << SLOT_BITS[i]) - 1),
                                    minlength=1 << SLOT_BITS[i])
        last = codes[-2:]
    return np.concatenate([c * (SCALE / max(c.sum(), 1)) for c in count])


def code_matrix(languages: int) -> np.ndarray:
    """A row of signs for each language."""
    if languages <= 2:
        return np.array([[1.0], [-1.0]])[:languages]
    if languages <= 5:
        columns = np.arange(1, 1 << (languages - 1))
        rows = [np.zeros(len(columns), int), *(columns >> i & 1 for i in range(languages - 1))]
        return 1.0 - 2.0 * np.array(rows)
    m = np.ones((1, 1))
    while len(m) < languages:
        m = np.block([[m, m], [m, -m]])
    return m[:languages, 1:]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray            # languages x columns
    weights: np.ndarray         # slots and a bias x columns
    reliability: np.ndarray     # a weight for each column

    def values(self, text: str) -> np.ndarray:
        x = frequencies(text)
        at = np.flatnonzero(x)
        return x[at] @ self.weights[at] + self.weights[-1]

    def losses(self, values: np.ndarray) -> np.ndarray:
        """Weighted logistic losses of every codeword; `values`: rows x columns."""
        out = np.empty((len(values), len(self.languages)))
        for i, signs in enumerate(self.code):
            out[:, i] = (np.logaddexp(0.0, -signs * values) * self.reliability).sum(axis=1)
        return out

    def decode(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: the nearest codeword (ties: the first), its share, whether another is nearly as near."""
        loss = self.losses(values)
        best = loss.argmin(axis=1)
        near = loss.min(axis=1, keepdims=True)
        share = np.exp(near - loss)
        ambiguous = ((loss - near) < AMBIGUOUS).sum(axis=1) > 1
        return best, 1.0 / share.sum(axis=1), ambiguous


def _snippet(text: str, turn: int) -> str:
    """A few words of the text; how many and where follows from the row's turn."""
    words = text.split()
    size = SNIPPETS[turn % len(SNIPPETS)]
    if len(words) <= size:
        return text
    at = turn * 7919 % (len(words) - size + 1)
    return " ".join(words[at:at + size])


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, epochs: int) -> np.ndarray:
    """Logistic regression of all columns at once, by steps that shrink with each slot's past gradients."""
    weights = np.zeros((SLOTS + 1, signs.shape[1]))
    past = np.full(weights.shape, 1e-3)
    for _ in range(epochs):
        for (at, x), y in zip(rows, signs):
            w = weights[at]
            g = np.outer(x, -y / (1.0 + np.exp(np.clip(y * (x @ w), -35, 35))))
            past[at] += g * g
            weights[at] = w - RATE * g / np.sqrt(past[at])
    return weights


def _row(text: str) -> tuple[np.ndarray, np.ndarray]:
    x = frequencies(text)
    at = np.flatnonzero(x)
    return np.append(at, SLOTS), np.append(x[at], 1.0)


def learn(texts: list[str], langs: list[str], epochs: int = EPOCHS) -> Model:
    """A model of all the languages in `langs`. Rows are taken in the given order; every fifth
    is kept from a first round of learning, which measures how reliable each column is."""
    languages = sorted(set(langs))
    code = code_matrix(len(languages))
    signs = code[[languages.index(x) for x in langs]]
    rows, y = [], []
    for turn, (text, s) in enumerate(zip(texts, signs)):
        rows += [_row(text), _row(_snippet(text, turn))]
        y += [s, s]
    y = np.array(y).reshape(len(rows), code.shape[1])
    fifth = np.arange(len(rows)) // 2 % 5 == 4
    first = _descend([r for r, f in zip(rows, fifth) if not f], y[~fifth], epochs)
    right = np.ones(code.shape[1])
    for (at, x), s in ((r, s) for r, s, f in zip(rows, y, fifth) if f):
        right += (x @ first[at]) * s > 0
    right = np.clip(right / (fifth.sum() + 2), 0.5, 0.999)
    reliability = np.log(right / (1 - right)) + 0.01
    return Model(languages, code, _descend(rows, y, epochs).astype(np.float32), reliability / reliability.mean())


def labelled_texts(docs: DataFrame, of: int, rest: int, per_language: int, languages: int) -> DataFrame:
    """(lang, at, text): at most `per_language` different rows of each of the `languages` most
    frequent languages, outside the held-out fold, the smallest hashes of identifier and text."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), of, rest)).select(
        "lang", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("at"), "text")
    often = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    keys = rows.select("lang", "at").join(F.broadcast(often), "lang").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    chosen = materialize(keys.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "at"))
    return rows.join(F.broadcast(chosen), ["lang", "at"]).groupBy("lang", "at").agg(F.first("text").alias("text"))


def fit(docs: DataFrame, of: int = 5, rest: int = 0, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model | None:
    """The model of the bounded sample, learned in one task; None without a labelled row."""
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(batches))
        if len(whole):
            whole = whole.sort_values(["at", "lang"], kind="stable")
            yield pd.DataFrame({"model": [pickle.dumps(learn(whole["text"].tolist(), whole["lang"].tolist()))]})

    row = labelled_texts(docs, of, rest, per_language, languages).repartition(1).mapInPandas(task, "model binary").first()
    return None if row is None else pickle.loads(row["model"])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """`docs` with lang_pred, score and ambiguous (each name after `prefix`).

    Whole texts are read. A null text and a text without a letter are `und` with score 0, and so is
    every text if nothing was learned. Existing columns of these names are replaced; every other
    column and every repeated row stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predicted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for text, known in parts:
            out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(text), "score": 0.0, "ambiguous": False})
            at = np.flatnonzero(known.to_numpy(dtype=bool))
            if model is not None and len(at):
                best, share, ambiguous = model.decode(np.array([model.values(t) for t in text.iloc[at]]))
                out.loc[at, "lang_pred"] = np.array(model.languages, dtype=object)[best]
                out.loc[at, "score"], out.loc[at, "ambiguous"] = share, ambiguous
            yield out

    text = F.col(f"`{text_col}`")
    names = {f"{prefix}{c}": c for c in ("lang_pred", "score", "ambiguous")}
    rows = docs.select(F.struct("*").alias("row"), predicted(text, has_letter(text)).alias("found"))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in names],
                       *[F.col(f"found.{c}").alias(k) for k, c in names.items()])


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")
