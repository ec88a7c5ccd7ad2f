"""Operator 6: quality rules as a learned decision list.

Counts of every whole text (words, characters, symbols, repeated lines and word
windows) are turned into features. From a bounded sample of labelled documents,
sequential covering learns an ordered list of rules for the bad ones: a rule is
grown on two thirds of the sample, condition by condition, by information gain;
pruned on the last third, where its last conditions go if it is better without
them; and kept while it is precise there. Covered documents leave the sample and
the next rule is grown. The list is emitted as one Spark conditional expression
over the counts, which anyone can read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from semdex.llm._common import SPACES, materialize, table
from semdex.llm.quality import labelled_sample

SAMPLE_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_distinct_words", "n_same_next", "n_upper", "n_marks")
_UPPER = bytes(range(65, 91))


def count_text(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one whole text; all 0 for null."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()        # bytes split at the ASCII white space that separates words
    windows = list(zip(words, words[1:], words[2:]))
    repeated, end = 0, 0
    if len(set(windows)) < len(windows):
        found = Counter(windows)
        for i, w in enumerate(windows):
            if found[w] > 1:    # words i to i+2, without those an earlier window has counted
                repeated += i + 3 - max(i, end)
                end = i + 3
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated, len(lines), len(set(words)),
            sum(map(eq, words, words[1:])), len(data) - len(data.translate(None, _UPPER)), text.count("!") + text.count("?"))


@F.pandas_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def text_counts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([count_text(t) for t in part], columns=COUNTS)


def features() -> dict[str, Column]:
    """Feature -> expression over the counts; of a text without words all are 0."""
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))
    return {"words": F.col("n_words").cast("double"), "word_length": per("word_chars", "n_words"),
            "symbols_a_word": per("n_symbols", "n_words"), "repeated_lines": per("n_dup_lines", "n_lines"),
            "repeated_words": per("n_repeat_words", "n_words"), "distinct_words": per("n_distinct_words", "n_words"),
            "same_as_next": per("n_same_next", "n_words"), "upper_letters": per("n_upper", "word_chars"),
            "marks_a_word": per("n_marks", "n_words")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: pd.DataFrame) -> np.ndarray:
        v = values[self.feature].to_numpy()
        return v >= self.threshold if self.above else v < self.threshold


def _covers(rule, values: pd.DataFrame) -> np.ndarray:
    hit = np.ones(len(values), dtype=bool)
    for c in rule:
        hit &= c.holds(values)
    return hit


def _best_condition(values: pd.DataFrame, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of most information gain for `bad` over all midpoints."""
    best, found = 0.0, None
    total, all_bad = len(bad), int(bad.sum())
    base = np.log2(all_bad / total)
    for name in values.columns:
        v = values[name].to_numpy()
        order = np.argsort(v, kind="stable")
        v, low_bad = v[order], np.cumsum(bad[order])
        ends = np.flatnonzero(v[1:] > v[:-1])
        if not len(ends):
            continue
        n_low, p_low = ends + 1, low_bad[ends]
        for above, p, n in ((False, p_low, n_low), (True, all_bad - p_low, total - n_low)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / n) - base)
            i = int(np.argmax(gain))
            if gain[i] > best + 1e-9:
                best, found = float(gain[i]), Condition(name, above, float((v[ends[i]] + v[ends[i] + 1]) / 2))
    return best, found


def learn_rules(values: pd.DataFrame, bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4,
                min_precision: float = 0.95, min_covered: int = 2) -> list[tuple[Condition, ...]]:
    """Ordered rules for `bad`; rows are taken in the given order, every third prunes."""
    bad = np.asarray(bad, dtype=bool)
    third = np.arange(len(bad)) % 3 == 2
    open_, rules = np.ones(len(bad), dtype=bool), []
    while len(rules) < max_rules:
        grow, prune = open_ & ~third, open_ & third
        if not bad[grow].any() or bad[grow].all():
            break
        rule, inside = [], grow.copy()
        while len(rule) < max_conditions and not bad[inside].all():
            gain, c = _best_condition(values[inside], bad[inside])
            if c is None:
                break
            rule.append(c)
            inside &= c.holds(values)

        def worth(r) -> float:
            hit = _covers(r, values) & prune
            return (2 * bad[hit].sum() - hit.sum()) / hit.sum() if hit.any() else -1.0

        prefixes = [tuple(rule[:k]) for k in range(1, len(rule) + 1)]
        if not prefixes:
            break
        rule = max(prefixes, key=lambda r: (worth(r), -len(r)))
        hit = _covers(rule, values) & prune
        if bad[hit].sum() < min_covered or bad[hit].mean() < min_precision:
            break
        rules.append(rule)
        open_ &= ~_covers(rule, values)
    return rules


def rule_expression(rules) -> Column:
    """True where no rule holds: ordered CASE WHEN conditions over the features."""
    columns = features()
    verdict = None
    for rule in rules:
        hit = F.lit(True)
        for c in rule:
            hit = hit & (columns[c.feature] >= c.threshold if c.above else columns[c.feature] < c.threshold)
        verdict = F.when(hit, F.lit(False)) if verdict is None else verdict.when(hit, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def count_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the COUNTS of every row's whole text; null and empty texts count 0
    everywhere; repeated rows and null identifiers stay; other columns are ignored."""
    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_counts(F.col(f"`{text_col}`")).alias("c"))
            .select("doc_id", "c.*"))


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, of: int = 5, rest: int = 0):
    """Learn the list from labels.quality; the driver gets at most `sample_rows`
    rows of nine numbers. Rows outside the fold crc32 mod `of` = `rest` are used;
    no labelled row gives an empty list, which keeps everything."""
    # a written table: else the counts would be taken below the join, of every document
    sample = materialize(labelled_sample(docs, labels, "quality", of, rest, sample_rows))
    counted = (sample.select("at", "y", text_counts("text").alias("c")).select("at", "y", "c.*")
               .where(~base_failed()).select("at", "y", *[f.alias(k) for k, f in features().items()]))
    rows = pd.DataFrame([r.asDict() for r in counted.collect()], columns=["at", "y", *features()])
    rows = rows.sort_values(list(rows.columns), kind="stable", ignore_index=True)
    return learn_rules(rows[list(features())], (rows["y"] == 0).to_numpy())


def judge(docs: DataFrame, rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, the counts, base_failed, kept."""
    return (count_documents(docs, id_col, text_col).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & rule_expression(rules)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                     "n_repeat_words", "base_failed", "kept")
