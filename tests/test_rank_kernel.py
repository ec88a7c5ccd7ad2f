"""The ranking kernel: exact under ties and close scores, at any block size; few groups of corpus rows."""

import numpy as np
import pytest

from semdex.operators import rank


@pytest.mark.parametrize("cells,rows", [(64, 16), (1 << 22, 2048)])
@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("size", [1.0, 1e-12, 1e16])
def test_kernel_is_exact(monkeypatch, cells, rows, text, size):
    monkeypatch.setattr(rank, "_BLOCK_CELLS", cells)
    monkeypatch.setattr(rank, "_BLOCK_ROWS", rows)
    rng = np.random.default_rng(5)
    P = rng.normal(size=(7, 8))
    P[2] = 0.0
    T = rng.normal(size=(400, 8))
    T[100:300] = T[100] + 1e-9 * rng.normal(size=(200, 8))      # closer than single precision tells apart
    T[150:250] = T[150]                                         # ties
    P *= size
    order = rng.permutation(400)
    keys = np.array([f"k{i:03d}" for i in order], dtype=object) if text else order
    excl = keys[:7]
    top = rank._TopK(P, excl, 12)
    for at in range(0, 400, 90):
        assert not list(top.add(keys[at:at + 90], T[at:at + 90]))
    got = top.cand
    S = np.stack([np.round(np.einsum("ij,ij->i", np.repeat(P[q:q + 1], 400, 0), T), rank.SCORE_PLACES) + 0.0 for q in range(7)])
    for q in range(7):
        want = sorted((-S[q, j], keys[j]) for j in range(400) if keys[j] != excl[q])[:12]
        mine = got[got["q"] == q]
        assert [(-s, k) for s, k in zip(mine["s"], mine["key"])] == want


def test_few_groups_of_corpus_rows():
    # 150,000 queries, 100,000 tables, 50 results: 200 groups before, whatever the sizes
    groups, blocks = rank.cells(100_000, 150_000, 512, 24 * 50, 12, 131_072)
    assert groups <= 4 and groups * blocks >= 24
    groups, blocks = rank.cells(10 ** 9, 1000, 512, 480, 12, 131_072)
    assert 10 ** 9 * 512 / groups <= rank._CELL_BYTES and blocks >= 1


def test_sift_keeps_every_best_table(monkeypatch):
    from semdex.plans import search as S
    monkeypatch.setattr(S, "BLOCK_CELLS", 60 * 50)
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(4, 16))
    matrix, products = S._query_matrix(3, vecs, 60, 0), vecs @ rng.normal(size=(16, 900))
    products[:, 100:130] = products[:, 500:530]         # ties
    held = vecs @ rng.normal(size=(16, 30))
    left = S.sift(matrix, products, 20, held)
    every = np.concatenate([held, products], axis=1)
    assert left.shape[1] < 700
    assert np.allclose(np.sort(S._best(matrix @ left, 20)), np.sort(S._best(matrix @ every, 20)))


def test_columns_are_not_sent_with_every_query(spark):
    """The tables' vectors meet the pairs in the last join, so no exchange repeats them for each query."""
    from semdex.operators import columns as C
    pairs = spark.createDataFrame([(1, "a")], "query_id long, table_name string")
    tables = spark.createDataFrame([("a", [(0, "x", [1.0, 0.0], 0.5)], 1)], "table_name string,"
                                   "cols array<struct<ord:long,name:string,vec:array<double>,quality:double>>, n int")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qvec array<double>")
    plan = C.table_columns(pairs, tables, q)._jdf.queryExecution().optimizedPlan().toString()
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join" in line]
    at = next(i for i, line in enumerate(plan.splitlines()) if "cols#" in line and "LogicalRDD" in line)
    assert len(joins) == 2 and "query_id" in plan.splitlines()[joins[1]] and at > joins[1]


def test_a_whole_ranking_is_handed_on_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(rank, "_RANKED_CELLS", 50)
    P, T, keys = rng.normal(size=(70, 4)), rng.normal(size=(23, 4)), np.arange(100, 123)
    parts = list(rank._TopK(P, None, None).add(keys, T))
    assert max(map(len, parts)) <= 50
    got = {(q, key): s for x in parts for q, key, s in x.itertuples(index=False)}
    assert got == {(q, 100 + j): s for (q, j), s in np.ndenumerate(np.round(P @ T.T, rank.SCORE_PLACES) + 0.0)}


def test_a_task_of_a_whole_ranking_holds_few_scores():
    # 134,000 queries and 102,000 tables: 8 tasks of 16 held 850 million scores each
    groups, blocks = rank.cells(102_000, 134_000, 8 * 64, 24, 6, 131_072, whole=True)
    assert (102_000 / groups) * (134_000 / blocks) <= 1 << 20


def test_whole_ranking_of_many_probes_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rank, "_RANKED_SIDE", 7)
    rng = np.random.default_rng(4)
    P, T = rng.normal(size=(40, 3)), rng.normal(size=(30, 3))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(T)], "t long, v array<double>")
    probes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(P)], "q long, p array<double>")
    got = rank.topk_dot(corpus, "t", "v", probes, ["q"], "p", None, max_probe_bytes=1024).collect()
    S = np.round(P @ T.T, rank.SCORE_PLACES)
    want = {(q, int(t)): (r + 1, S[q, t]) for q in range(40) for r, t in enumerate(np.lexsort((np.arange(30), -S[q])))}
    assert len(got) == 1200 and all(want[x["q"], x["t"]] == (x["rank"], pytest.approx(x["score"], abs=1e-9)) for x in got)
