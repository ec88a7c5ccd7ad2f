"""Approximate nearest terms against the exact path and against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from semdex.operators.rank import nearest_terms
from semdex.operators.term_index import bucket_order, build_index, fit_probes, nearest_terms_indexed
from semdex.plans.context import Inputs


def rows_of(df):
    return {(r["query_id"], r["nb_rank"]): (r["query"], r["term"], round(r["raw_score"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered(spark):
    """3,000 words round 40 centres, a third of all with one and the same vector."""
    rng = np.random.default_rng(3)
    at = rng.normal(size=(40, 24))
    vecs = at[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    vecs[::3] = vecs[0]
    words = spark.createDataFrame([(i, f"w{i}", v.tolist()) for i, v in enumerate(vecs)],
                                  "rank long, term string, vec array<double>")
    asked = spark.createDataFrame([(i, f"w{i * 7}") for i in range(400)] + [(900, "unheard"), (901, ""), (902, None)],
                                  "query_id long, query string")
    return words, asked


def test_bucket_order_by_brute_force():
    rng = np.random.default_rng(1)
    for bits in (0, 1, 5):
        m = rng.normal(size=bits)
        own = sum(1 << j for j in range(bits) if m[j] > 0)
        cost = {sum(1 << j for j in s): sum(m[j] ** 2 for j in s)
                for r in range(bits + 1) for s in itertools.combinations(range(bits), r)}
        want = [own ^ f for f in sorted(cost, key=cost.get)]
        for n in (1, 3, 1 << bits):
            assert bucket_order(m, n).tolist() == want[:n]


@pytest.mark.parametrize("block_rows,block_probes", [(8192, 1024), (97, 13)])
def test_all_buckets_are_exact(clustered, block_rows, block_probes):
    words, asked = clustered
    index = build_index(words, bits=3)
    got = nearest_terms_indexed(index, asked, 20, n_probes=8, block_rows=block_rows, block_probes=block_probes)
    assert rows_of(got) == rows_of(nearest_terms(words, asked, 20))


def test_every_row_is_indexed_once(clustered):
    words, _ = clustered
    index = build_index(words)
    assert index.bits == 6
    assert sorted(r[0] for r in index.rows.select("rank").collect()) == list(range(3000))


def recall_of(index, words, asked, topn, n_probes):
    exact, got = rows_of(nearest_terms(words, asked, topn)), rows_of(nearest_terms_indexed(index, asked, topn, n_probes))
    true = {(q, v[1]): v[2] for (q, _), v in exact.items()}
    mine = {(q, v[1]): v[2] for (q, _), v in got.items()}
    both = true.keys() & mine.keys()
    assert all(true[k] == mine[k] for k in both)
    for q in {q for q, _ in got}:      # ranks have no gaps, scores fall
        at = sorted(r for p, r in got if p == q)
        assert at == list(range(1, len(at) + 1))
        scores = [got[q, r][2] for r in at]
        assert scores == sorted(scores, reverse=True)
    return len(both) / len(true)


def test_recall_with_few_buckets(clustered):
    """Queries outside the fitted sample keep the recall, and much of the index is not read."""
    words, asked = clustered
    index = build_index(words)
    n_probes = fit_probes(index, asked, topn=30, sample=100)
    assert n_probes <= 32
    assert recall_of(index, words, asked, 30, n_probes) >= 0.9


def test_recall_of_300_neighbours_in_the_whole_vocabulary(spark):
    ctx = Inputs(spark, SF001)
    index = build_index(ctx.word_vectors)
    n_probes = fit_probes(index, ctx.queries)
    assert recall_of(index, ctx.word_vectors, ctx.queries, 300, n_probes) >= 0.9


def test_empty_tables(clustered):
    words, asked = clustered
    index = build_index(words.where(F.lit(False)))
    assert index.bits == 0 and nearest_terms_indexed(index, asked, 5).count() == 0
    assert nearest_terms_indexed(build_index(words), asked.where(F.lit(False)), 5).count() == 0
