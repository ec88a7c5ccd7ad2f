"""E1-E6, L5-L10, T11 on a small vocabulary with the terms that must come out."""

import functools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from semdex.functions.lexical import length_bound, letters_bound, levenshtein_join, py_ratio, with_ratio_below
from semdex.operators.expand import contextual_similarity, expand_queries, filter_candidates, hybrid_scores
from semdex.operators.rank import nearest_terms

WORDS = [("heart", [1.0, 0.0]), ("hearts", [1.0, 0.01]), ("vein2", [0.95, 0.3]), ("cardiac", [0.9, 0.4]),
         ("cardiacs", [0.89, 0.41]), ("renal", [0.3, 0.9]), ("kidney", [0.0, 1.0]), ("void", [0.0, 0.0])]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(WORDS)], "rank long, term string, vec array<double>")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def terms(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["pos"])):
        out.setdefault(r["query_id"], []).append(r["term"])
    return out


def test_filters(spark, words):
    nb = nearest_terms(words, queries(spark, "heart"), 300)
    got = {(r["pass"], r["clean"]) for r in filter_candidates(nb, 10).collect()}
    # hearts contains the query; vein2 has a digit, which only the back-fill admits
    assert got == {(1, t) for t in ("cardiac", "cardiacs", "renal", "kidney", "void")} | {(2, "vein2")}
    enough = {(r["pass"], r["clean"]) for r in filter_candidates(nb, 3).collect()}
    assert enough == {(1, t) for t in ("cardiac", "cardiacs", "renal", "kidney", "void")}


def test_expansion(spark, words):
    got = expand_queries(queries(spark, "Heart", "", "heart attack", " kidney "), words, 2, n=3, use_context=False)
    # cardiacs is too like cardiac; the walk ends after n - 1 terms; empty queries give nothing
    assert terms(got) == {0: ["heart", "cardiac", "renal"], 2: ["heart attack"], 3: ["kidney", "renal", "cardiacs"]}
    scores = {r["term"]: r["score"] for r in got.where("query_id = 0").collect()}
    cos = 0.9 / math.hypot(0.9, 0.4)
    assert scores["heart"] == 1.0
    assert scores["cardiac"] == pytest.approx(0.6 * 0.5 + 0.3 * (cos + 1) / 2 + 0.1 * math.tanh(0.9 / 1e4))


def test_back_fill_and_translation(spark, words):
    lexicon = spark.createDataFrame([("fr", "en", "coeur", "heart"), ("en", "fr", "heart", "coeur"), ("en", "fr", "cardiac", "cardiaque")],
                                    "src_lang string, dst_lang string, src string, dst string")
    got = expand_queries(queries(spark, "Coeur", "renal"), words, 2, n=10, use_context=False, lexicon=lexicon)
    words_ = {t: v for t, v in WORDS}
    plain = plain_expansion({0: "heart", 1: "renal"}, words_, 10)
    back = {"heart": "coeur", "cardiac": "cardiaque"}
    assert terms(got)[0] == [back.get(t, t) for t in plain[0]] and "cardiaque" in terms(got)[0]
    assert terms(got)[1] == plain[1] and "cardiaque" not in terms(got)[1]


def plain_filter(ranked, query, n, similar):
    """L5-L9 in plain Python: (pass, rank, term) of a query's ranked neighbours."""
    allowed = [(r, t) for r, t in ranked if t != query and query.replace("-", "") not in t.replace("-", "")]
    strict = [(1, r, t) for r, t in allowed if not any(c.isdigit() for c in t) and similar(query, t) < 0.5]
    if len(strict) >= n:
        return strict
    kept = {t for _, _, t in strict}
    spare = [(2, r, t) for r, t in allowed if r <= max(50, 3 * n) and t not in kept]
    return strict + spare[:3 * n - len(strict)]


def plain_expansion(queries, words_, n, similar=py_ratio, context=None, topn=300):
    """E6 in plain Python for known queries, without translation; {query_id: terms}."""
    names, m = list(words_), np.array(list(words_.values()), dtype=float)
    length = np.sqrt((m * m).sum(axis=1))
    unit = m / np.where(length == 0, 1, length)[:, None]
    out = {}
    for qid, q in queries.items():
        qi = names.index(q)
        cos = np.round(unit @ unit[qi], 10) + 0.0
        order = [i for i in np.lexsort((np.arange(len(names)), -cos)) if i != qi][:topn]
        scored = []
        for p, r, t in plain_filter([(k + 1, names[i]) for k, i in enumerate(order)], q, n, similar):
            i = names.index(t)
            d, den = float(m[qi] @ m[i]), length[qi] * length[i]
            w2v = d / den if den else math.nan
            bert = context(q, t) if context else 0.0
            score = (0.6 * (min(1.0, max(-1.0, bert)) + 1) / 2 if context else 0.6 * 0.5) + 0.3 * (w2v + 1) / 2 + 0.1 * math.tanh(d / 1e4)
            scored.append((math.isnan(score), -round(score, 10) if not math.isnan(score) else 0.0, p, r, t))
        kept = []
        for *_, t in sorted(scored):
            if len(kept) < max(1, n - 1) and all(similar(t, k) <= 0.6 for k in kept):
                kept.append(t)
        out[qid] = [q, *kept]
    return out


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def whole(spark):
    """Vocabulary and known queries of the whole sf0.001 tables, and E1 computed word by word."""
    from conftest import SF001
    from semdex.functions.text import CONTEXT_TEMPLATES
    from semdex.plans.registry import Inputs
    ctx = Inputs(spark, SF001)
    words_ = {r["term"]: list(r["vec"]) for r in ctx.word_vectors.orderBy("rank").collect()}
    known = {r["query_id"]: r["query"] for r in ctx.queries.collect() if r["query"] in words_}

    @functools.lru_cache(maxsize=None)
    def texts(w):
        out = []
        for t in CONTEXT_TEMPLATES:
            toks = re.findall("[a-z0-9]+", t.replace("{}", w, 1).replace("{}", "").lower())
            v = np.sum([words_[x] for x in toks if x in words_] or [np.zeros(ctx.dim)], axis=0).astype(float)
            n = np.sqrt(v @ v)
            out.append(v / n if n else v)
        return out

    return ctx, words_, known, lambda a, b: float(np.mean([x @ y for x, y in zip(texts(a), texts(b))]))


@pytest.mark.parametrize("lexical", ["ratio", "levenshtein"])
def test_whole_table_expansion_against_plain_python(spark, whole, lexical):
    ctx, words_, known, context = whole
    similar = py_ratio if lexical == "ratio" else lambda a, b: 1 - plain_levenshtein(a, b) / max(len(a), len(b))
    got = terms(expand_queries(ctx.queries, ctx.word_vectors, ctx.dim, n=10, lexical=lexical))
    want = plain_expansion(known, words_, 10, similar, context)
    assert len(known) > 20 and {k: v for k, v in got.items() if k in known} == want
    assert all(len(v) == 1 for k, v in got.items() if k not in known)


def test_whole_table_filter_against_plain_python(spark, whole):
    ctx, _, known, _ = whole
    nb = nearest_terms(ctx.word_vectors, ctx.queries, 300)
    ranked = {}
    for r in nb.collect():
        ranked.setdefault(r["query_id"], []).append((r["nb_rank"], r["term"]))
    for n in (10, 200):
        got = sorted((r["query_id"], r["pass"], r["nb_rank"], r["clean"]) for r in filter_candidates(nb, n).collect())
        assert got == sorted((q, *x) for q, rs in ranked.items() for x in plain_filter(sorted(rs), known[q], n, py_ratio))


def test_letters_bound(spark):
    """Never under the ratio, and it spares most of what the length bound leaves to Python."""
    rng = np.random.default_rng(2)
    alphabet = list("abcdeé😀 -")
    rows = [("".join(rng.choice(alphabet, rng.integers(0, 9))), "".join(rng.choice(alphabet, rng.integers(0, 9)))) for _ in range(1500)]
    rows += [("", ""), ("a", ""), ("heart", "earth"), ("abc", "xyz")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("by_letters", letters_bound(F.col("a"), F.col("b"))).withColumn(
        "by_length", length_bound(F.col("a"), F.col("b")))
    left = 0
    for r in df.collect():
        assert r["by_letters"] >= py_ratio(r["a"], r["b"]) - 1e-12 and r["by_letters"] <= r["by_length"] + 1e-12
        left += r["by_letters"] >= 0.5
    assert left < 0.6 * df.where("by_length >= 0.5").count()
    kept = sorted((r["a"], r["b"]) for r in with_ratio_below(df, "a", "b", 0.5).collect())
    assert kept == sorted((a, b) for a, b in rows if py_ratio(a, b) < 0.5)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_levenshtein_join_against_all_pairs(spark, distance):
    rng = np.random.default_rng(distance)
    some = lambda n: sorted({"".join(rng.choice(list("abé"), rng.integers(0, 8))) for _ in range(n)})
    a, b = some(120), some(140)
    got = levenshtein_join(spark.createDataFrame([(x,) for x in [*a, None, a[0]]], "a string"),
                           spark.createDataFrame([(x,) for x in [*b, None]], "b string"), "a", "b", distance)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    want = sorted((x, y, plain_levenshtein(x, y)) for x in a for y in b if plain_levenshtein(x, y) <= distance)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_zero_vector_gives_nan_not_an_error(spark, words):
    pairs = spark.createDataFrame([(0, "heart", "void", 1)], "query_id long, query string, clean string, nb_rank long")
    r = hybrid_scores(pairs, words, 2, use_context=False).first()
    assert math.isnan(r["w2v_cos"]) and r["cooc"] == 0.0


def test_context_is_the_mean_of_four_cosines(spark, words):
    pairs = spark.createDataFrame([(0, "heart", "renal"), (0, "heart", "zzz")], "query_id long, query string, clean string")
    got = {r["clean"]: r["bert_raw"] for r in contextual_similarity(pairs, words, 2).collect()}
    # of the templates' words only the slot has a vector here
    assert got["renal"] == pytest.approx(0.3 / math.hypot(0.3, 0.9)) and got["zzz"] == 0.0
