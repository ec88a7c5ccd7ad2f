import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from semdex.llm import rules
from .conftest import ODD

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    found = Counter(windows)
    inside = {j for i, w in enumerate(windows) if found[w] > 1 for j in range(i, i + 3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_counts_match_brute_force():
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] + [t for _, t, *_ in ODD]
    texts += ["a b c a b c a b c", "a a a a", "a b c d a b c", "x\n\nx\n x\n", "#| a\n#| a\n", "a b a b a b"]
    for t in texts:
        assert rules.count_text(t)[:5] == brute(t), (t or "")[:60]


def test_learns_a_planted_list():
    rng = np.random.default_rng(5)
    values = pd.DataFrame({"a": rng.random(1500), "b": rng.random(1500), "c": rng.random(1500)})
    bad = ((values.a > 0.8) & (values.b < 0.5) | (values.c > 0.93)).to_numpy()
    learned = rules.learn_rules(values, bad)
    hit = np.zeros(len(values), bool)
    for r in learned:
        hit |= rules._covers(r, values)
    assert (hit == bad).mean() > 0.97 and 2 <= len(learned) <= 6
    assert rules.learn_rules(values, np.zeros(1500, bool)) == []


def test_noise_gives_no_rule():
    rng = np.random.default_rng(6)
    values = pd.DataFrame({"a": rng.random(900)})
    assert rules.learn_rules(values, rng.random(900) < 0.1) == []


def test_expression_is_the_list(spark, documents):
    learned = [(rules.Condition("symbols_a_word", True, 0.2),), (rules.Condition("words", False, 60), rules.Condition("repeated_words", True, 0.3))]
    rows = ODD + [(20, "w# " * 80), (21, "plain word list " + " ".join(map(str, range(90)))), (22, "one two three " * 18)]
    got = rules.judge(documents(rows), learned).collect()
    assert len(got) == len(rows)
    for r in got:
        per = lambda a, b: a / b if b else 0.0
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        hit = per(r.n_symbols, r.n_words) >= 0.2 or r.n_words < 60 and per(r.n_repeat_words, r.n_words) >= 0.3
        assert (r.base_failed, r.kept) == (failed, not failed and not hit)
    assert rules.judge(documents([]), learned).count() == 0
    assert rules.judge(documents([(21, rows[-2][1])]), []).first().kept


def test_held_out(spark):
    got = rules.op6_quality_rules(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = got[~got.base_failed & got.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 5 == 0)]
    assert held[held.quality == 1].kept.mean() >= 0.98 and (~held[held.quality == 0].kept).mean() >= 0.8
