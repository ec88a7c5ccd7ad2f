"""Operator 10: toxicity behind a noisy-channel deobfuscation.

What a disguised word may stand for is a lattice of characters: a digit or symbol
for the letters it resembles, a repeated character for one of its kind, blanks or
points between single letters for nothing. A Viterbi search finds the path that
is likeliest under the channel's costs and a character trigram model, which is
counted over all documents. Only text that has more than one reading needs the
search: tokens with a letter and a look-alike, a separator before a letter or a
doubled letter, and three or more single characters in a row. Symbols at the end
of a token are read as letters or left as they are, whichever is likelier. The restored
text is scored by logistic regression over the words it holds and their beginnings,
learned with FTRL from a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.llm._common import table
from semdex.llm.quality import ftrl, held_out, labelled_sample

SAMPLE_ROWS = 12_000
BITS = 20
EPOCHS = 4
THRESHOLD = 0.3
MEMO_WORDS = 300_000
CHUNK_CHARS = 1 << 20

# fixed values: characters and the letters they may stand for
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
               "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
               "*": "aeiou", "#": "aeiou", "%": "aeiou"}
SEPARATORS = " .-_~*"
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëçàâîïôûùœñáíóú"
# channel costs: a look-alike; a dropped character of a long run, of a pair; a dropped separator, a dropped star; a symbol as it is
ALIKE, RUN, PAIR, JOIN, STAR, LITERAL = 0.7, 0.5, 2.5, 0.2, 1.5, 9.0
LONE = 3.0              # besides PAIR in a token of letters only: about what a letter costs, else the shorter word would win by its length

SYMBOLS = 64            # 0: a word's end, 1: any other character, then the letters
SYMBOL = {c: i + 2 for i, c in enumerate(LETTERS)} | dict.fromkeys(" \t\n\x0b\x0c\r", 0)
_TABLE = np.ones(65536, dtype=np.int64)
for _c, _i in SYMBOL.items():
    _TABLE[ord(_c)] = _i
    if len(_c.upper()) == 1:
        _TABLE[ord(_c.upper())] = _i

_odd = re.escape("".join(LOOK_ALIKES) + SEPARATORS.strip())
_alike = re.escape("".join(LOOK_ALIKES))
_TOKEN = re.compile(rf"(?<!\S)(?:[^\s{_odd}]*+[{_odd}](?=\S*[^\W\d_])\S*"
                    rf"|(?:[^\w\s]|[\d_])*+[^\W\d_][^\s{_alike}]*+[{_alike}]\S*|\S*?([^\W\d_])\1\S*)")
_SINGLES = re.compile(r"(?<!\S)(?:(?:\S +){3,}\S|(?=(?:\S +){0,2}[^\W\d_])(?:\S +){2}\S)[.,;:?!]*(?!\S)")
_TAIL = re.compile(rf"(?<=\w)[^\w\s]*[{re.escape(''.join(c for c in LOOK_ALIKES if not c.isdigit()))}][^\w\s]*\Z")
_DOUBLE = re.compile(r"([^\W\d_])(?=\1)")
_MARKS = ".,;:?\"')"
_FREE_TAIL = re.compile(r"(?:[.,;:?!]|([^\w\s])\1\1+)*\Z")    # sentence marks, a symbol three times or more
_WORD = re.compile(r"[^\W\d_]+")


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over the whole texts of all rows: a task sums
    its texts, Spark sums the tasks, the driver gets at most SYMBOLS**3 numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, dtype=np.int64)

        def add(texts: list[str]) -> None:
            code = np.frombuffer("  ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
            a = _TABLE[np.minimum(code, 65535)]
            np.add(total, np.bincount((a[:-2] * SYMBOLS + a[1:-1]) * SYMBOLS + a[2:], minlength=len(total)), out=total)

        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held.append(text)
                    size += len(text)
                    if size >= CHUNK_CHARS:
                        add(held)
                        held, size = [], 0
        if held:
            add(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["t", "n"])

    found = (docs.select(F.col(f"`{text_col}`")).mapInArrow(count, "t long, n long")
             .groupBy("t").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(SYMBOLS ** 3, dtype=np.int64)
    for r in found:
        out[r["t"]] = r["n"]
    return out


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), interpolated with the bigram and a uniform share."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p3 = three / np.maximum(three.sum(axis=2, keepdims=True), 1)
    p2 = two / np.maximum(two.sum(axis=1, keepdims=True), 1)
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    return -np.log(0.8 * p3 + 0.15 * p2[None] + 0.04 * p1[None, None] + 0.01 / SYMBOLS).astype(np.float32).ravel()


class Restorer:
    """Lower-cases a text and puts the likeliest reading in place of what is disguised."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.memo: dict[str, str] = {}
        self.pairs: dict[str, bool] = {}

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """Per character its readings: what it is written as, and at what cost."""
        out, pair = [], PAIR + LONE * _TAIL.sub("", token).strip(_MARKS).isalpha()
        for i, c in enumerate(token):
            before = token[i - 1] if i else ""
            run = c == before and (token[i - 2:i - 1] == c or token[i + 1:i + 2] == c)
            if c in LOOK_ALIKES:
                letters = LOOK_ALIKES[c]
                ways = [(x, ALIKE + log(len(letters))) for x in letters] + [(c, LITERAL)]
                if c in SEPARATORS or c == before:
                    ways.append(("", STAR if c != before else RUN))
            elif c in SEPARATORS:
                ways = [("", JOIN), (" " if c == " " else c, 0.0)]
            else:
                ways = [(c, 0.0)]
                if c == before:
                    ways.append(("", RUN if run else pair))
            out.append(ways)
        return out

    def search(self, token: str) -> tuple[float, str]:
        """Cost and text of the cheapest path."""
        costs, paths = self.costs, {0: (0.0, None)}     # state: the last two symbols
        for ways in self.lattice(token):
            if len(ways) == 1 and len(paths) == 1:
                [(state, (cost, path))], written = paths.items(), ways[0][0]
                s = SYMBOL.get(written, 1)
                paths = {(state % SYMBOLS) * SYMBOLS + s: (cost + costs[state * SYMBOLS + s], (written, path))}
                continue
            ahead: dict[int, tuple[float, object]] = {}
            for state, (cost, path) in paths.items():
                for written, extra in ways:
                    if written:
                        s = SYMBOL.get(written, 0 if written in SEPARATORS else 1)
                        total, to = cost + extra + costs[state * SYMBOLS + s], (state % SYMBOLS) * SYMBOLS + s
                    else:
                        total, to = cost + extra, state
                    if to not in ahead or total < ahead[to][0]:
                        ahead[to] = (total, (written, path) if written else path)
            paths = ahead
        least, _, path = min((cost + costs[state * SYMBOLS], i, path) for i, (state, (cost, path)) in enumerate(paths.items()))
        out = []
        while path is not None:
            written, path = path
            out.append(written)
        return least, "".join(reversed(out))

    def decode(self, token: str) -> str:
        return self.search(token)[1]

    def doubtful(self, token: str) -> bool:
        """Whether a path that drops one of a doubled letter can win: the costs of a lone pair hang on its neighbours alone."""
        token, pairs = f" {token} ", self.pairs
        for m in _DOUBLE.finditer(token):
            near = token[m.start() - 1:m.start() + 3]
            found = pairs.get(near)
            if found is None:
                p, x, _, d = (SYMBOL.get(c, 0 if c in SEPARATORS else 1) for c in near)
                kept, dropped = (p * SYMBOLS + x) * SYMBOLS, (x * SYMBOLS + x) * SYMBOLS
                found = near[3] == near[1] or self.costs[kept + x] + self.costs[dropped + d] - self.costs[kept + d] > PAIR + LONE
                if len(pairs) < MEMO_WORDS:
                    pairs[near] = found
            if found:
                return True
        return False

    def surely_ends(self, core: str, tail: str) -> bool:
        """Whether no letter that the symbols may stand for can be likelier than a word's end."""
        if not _FREE_TAIL.match(tail) or not LOOK_ALIKES.keys() >= set(tail):
            return False
        a, b = (SYMBOL.get(c, 0 if c in SEPARATORS else 1) for c in (" " + core)[-2:])
        state = (a * SYMBOLS + b) * SYMBOLS
        end = self.costs[state]
        return all(end <= ALIKE + log(len(LOOK_ALIKES[c])) + self.costs[state + SYMBOL[x]] for c in set(tail) for x in LOOK_ALIKES[c])

    def read(self, token: str) -> str:
        """The token decoded; the word may also end before the symbols at its end, which then stay."""
        found = self.memo.get(token)
        if found is not None:
            return found
        tail = None if token[-1:].isalnum() else _TAIL.search(token)
        core = token[:tail.start()] if tail else token
        if core.strip(_MARKS).isalpha() and not self.doubtful(core) and (not tail or self.surely_ends(core, tail[0])):
            found = token
        else:
            cost, found = self.search(token)
            if tail:
                ends, word = self.search(core)
                if ends + (0.0 if _FREE_TAIL.match(tail[0]) else LITERAL) <= cost:
                    found = word + tail[0]
        if len(self.memo) < MEMO_WORDS:
            self.memo[token] = found
        return found

    def restore(self, text: str) -> str:
        text = _SINGLES.sub(lambda m: self.read(re.sub(" +", " ", m[0])), text.lower())
        return _TOKEN.sub(lambda m: self.read(m[0]), text)


class _Slots(dict):
    """Word -> slots of the word and of its first four and five characters, four bytes each."""

    def __missing__(self, w: str) -> bytes:
        grams = {w, f"^{w[:4]}", f"^{w[:5]}"} if len(w) > 3 else {w}
        found = b"".join((crc32(g.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)).to_bytes(4, "little")
                         for g in sorted(grams))
        if len(self) < MEMO_WORDS:      # frequent words come early: a full memo stays as it is
            self[w] = found
        return found


def word_slots(text: str | None, restorer: Restorer, slots: _Slots) -> np.ndarray:
    """Sorted distinct slots of the words of the restored whole text."""
    words = set(_WORD.findall(restorer.restore(text))) if text else ()
    return np.unique(np.frombuffer(b"".join(map(slots.__getitem__, words)), "<u4"))


def score_words(at: np.ndarray, weights: np.ndarray) -> float:
    return 1.0 / (1.0 + exp(-max(-35.0, min(35.0, float(weights[-1]) + float(weights[at].sum())))))


def train(texts, labels, costs: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by slot, the bias last; rows are taken in the given order."""
    restorer, slots, size = Restorer(costs), _Slots(), (1 << BITS) + 1
    rows = [np.append(word_slots(t, restorer, slots), size - 1) for t in texts]
    return ftrl([(at, np.ones(len(at), np.float32)) for at in rows], labels, size, epochs,
                alpha=1.0, beta=1.0, l1=2.0, l2=0.05)


def fit(docs: DataFrame, labels: DataFrame, costs: np.ndarray, of: int = 4, rest: int = 2,
        sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from labels.toxic on the bounded sample, in one task of an executor; all 0 without labelled rows."""
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(batches))
        whole = whole.sort_values(["at", "text"], kind="stable")
        yield pd.DataFrame({"w": [train(whole["text"], whole["y"].to_numpy(dtype=float), costs).tobytes()]})

    sample = labelled_sample(docs, labels, "toxic", of, rest, sample_rows)
    row = sample.repartition(1).mapInPandas(learn, "w binary").first()
    return np.zeros((1 << BITS) + 1, np.float32) if row is None else np.frombuffer(row["w"], dtype=np.float32)


def score(docs: DataFrame, costs: np.ndarray, weights: np.ndarray, text_col: str = "text",
          score_col: str = "score") -> DataFrame:
    """`docs` with `score_col`: 0 to 1, higher: label 1 likelier.

    Whole texts are restored and scored; null and empty texts get the score of
    the bias alone. An existing column of that name is replaced; every other
    column and every repeated row stays. Both models have a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((costs, weights))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        costs, weights = shared.value
        restorer, slots = Restorer(costs), _Slots()
        for part in parts:
            yield pd.Series([score_words(word_slots(t, restorer, slots), weights) for t in part], dtype="float64")

    return docs.withColumn(score_col, scored(F.col(f"`{text_col}`")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    costs = trigram_costs(trigram_counts(docs))
    weights = fit(docs, table(spark, sf_dir, "labels"), costs)
    return score(docs, costs, weights).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
