"""The encoder by blocks of words and parts of texts, and the edit-distance join of short strings, by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semdex.functions import lexical
from semdex.operators import encode


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i] + row[1:], row
        for j, y in enumerate(b, 1):
            row[j] = min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y))
    return row[-1]


@pytest.mark.parametrize("word_bytes,chars,part", [(128 << 20, 48 << 20, 4096), (400, 100, 3)])
def test_blocks_and_parts_give_the_mean(spark, monkeypatch, word_bytes, chars, part):
    for name, value in (("_WORD_BYTES", word_bytes), ("_CELL_CHARS", chars), ("_LEAST_CHARS", chars), ("_PART_TOKENS", part), ("_GATHERED", part)):
        monkeypatch.setattr(encode, name, value)
    rng = np.random.default_rng(4)
    names, vecs = [f"w{i}" for i in range(120)], rng.normal(size=(120, 3))
    words = spark.createDataFrame([(i, w, v.tolist()) for i, (w, v) in enumerate(zip(names, vecs))], "rank long, term string, vec array<double>")
    texts = [(i, None if i == 3 else "unheard" if i == 4 else " ".join(rng.choice(names + ["zz"], size=rng.integers(0, 60)))) for i in range(30)]
    df = spark.createDataFrame(texts, "k long, t string")
    got = {r["k"]: r["vec"] for r in encode.encode_texts(df, "t", words, 3, key=["k"], max_tokens=None).collect()}
    sums = {r["k"]: r["vec"] for r in encode.encode_sums(df, "t", words, 3, ["k"]).collect()}
    part_rows = encode._partial_means(df, ["k"], "t", words, 3)
    assert "Join" not in part_rows._jdf.queryExecution().optimizedPlan().toString()     # no row a token and vector
    for k, t in texts:
        at = [int(w[1:]) for w in (t or "").split() if w not in ("zz", "unheard")]
        want = vecs[at].sum(axis=0) if at else np.zeros(3)
        assert np.allclose(sums[k], want) and np.allclose(got[k], want / max(1, len(at)))


@pytest.mark.parametrize("chars, texts, cores", [(2 << 20, 12_000, 8), (165 << 20, 50_000, 8), (165 << 20, 50_000, 12), (6 << 30, 2_000_000, 12)])
def test_words_are_not_sent_for_each_core(chars, texts, cores):
    """c6, c7, c8 and the index: with blocks of words for the cores, words are sent to as few groups of texts as send least."""
    words, dim = 655_132, 64
    blocks, groups = encode.encoder_cells(chars, texts, words, dim, cores)
    size = words * dim * 4
    assert size / blocks <= encode._WORD_BYTES and chars / (blocks * groups) <= encode._CELL_CHARS
    assert blocks * groups >= min(cores, chars >> 20)
    at = max(1, -(-size // encode._WORD_BYTES))     # before: as few blocks as hold the words, groups for all cores
    was = max(1, -(-chars // (encode._CELL_CHARS * at)), min(-(-cores // at), chars >> 20))
    assert groups * size + blocks * texts * dim * 8 < 0.75 * (was * size + at * texts * dim * 8)


def test_distinct_texts_travel_as_numbers(spark, monkeypatch):
    groups, means = [], encode._partial_means
    monkeypatch.setattr(encode, "_partial_means", lambda texts, group, *rest: groups.append(group) or means(texts, group, *rest))
    words = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 4.0])], "rank long, term string, vec array<double>")
    texts = [(0, "a b"), (1, "a b"), (2, "a"), (3, None), (4, ""), (5, "zz"), (6, "a b b")]
    got = {r["k"]: r["vec"] for r in encode.encode_texts(spark.createDataFrame(texts, "k long, t string"), "t", words, 2).collect()}
    assert groups == [["__id"]]
    assert got == {0: [0.5, 2.0], 1: [0.5, 2.0], 2: [1.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [0.0, 0.0], 6: pytest.approx([1 / 3, 8 / 3])}


@pytest.mark.parametrize("short", [64, 3])
def test_deletions_join_by_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(lexical, "SHORT", short)
    rng = np.random.default_rng(6)
    some = ["", "a", "b", "é", "ab", "ba", "aa", "aaa", "aab"] + ["".join(rng.choice(list("abé"), size=rng.integers(1, 7))) for _ in range(60)]
    left, right = sorted(set(some[::2] + ["aaaa"])), sorted(set(some[1::2] + [""]))
    a = spark.createDataFrame([(x,) for x in left + [None]], "x string")
    b = spark.createDataFrame([(x,) for x in right + [None]], "y string")
    got = sorted(tuple(r) for r in lexical.levenshtein_join(a, b, "x", "y", 1).collect())
    assert got == sorted((x, y, edits(x, y)) for x in left for y in right if edits(x, y) <= 1)


def test_short_strings_share_few_rests(spark):
    """Candidates of 20,000 numbers: each rest has few of them, whereas a segment of three digits had 20."""
    df = spark.range(100_000, 120_000).select(F.col("id").cast("string").alias("x"))
    pairs = lexical.levenshtein_join(df, df.withColumnRenamed("x", "y"), "x", "y", 1)
    assert "__part" not in lexical._deletions_join(df, df.withColumnRenamed("x", "y"), "x", "y")._jdf.queryExecution().toString()
    assert pairs.where("distance = 0").count() == 20_000


@pytest.mark.parametrize("distance", [1, 2])
def test_levenshtein_join_broadcasts_no_side(spark, distance):
    # what the strings are cut into is many times what the planner knows of their size
    df = spark.createDataFrame([(f"{i:05d}",) for i in range(300)], "x string")
    pairs = lexical.levenshtein_join(df, df.withColumnRenamed("x", "y"), "x", "y", distance)
    assert pairs.count() > 300
    plan = pairs._jdf.queryExecution().executedPlan()
    pairs.collect()
    assert "SortMergeJoin" in plan.toString() and "Broadcast" not in plan.toString()
