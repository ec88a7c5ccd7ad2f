"""Ranking kernel against numpy brute force: ties, zero probes, chunking, partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semdex.operators.rank import topk_dot


def brute(P, keys, Tm, tkeys, k, excl=None):
    out = {}
    for i, pk in enumerate(keys):
        s = Tm @ P[i]
        rows = [(round(float(s[j]), 10), int(tkeys[j])) for j in range(len(tkeys)) if excl is None or tkeys[j] != excl[i]]
        rows.sort(key=lambda r: (-r[0], r[1]))
        out[pk] = [(r[1], round(r[0], 9)) for r in rows[:k]]
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    Tm = rng.normal(size=(300, 16))
    Tm[10] = Tm[11]  # exact tie
    P = rng.normal(size=(9, 16))
    P[3] = 0.0  # all-zero probe: every score ties at 0
    corpus = spark.createDataFrame([(int(i), Tm[i].tolist()) for i in range(300)], "id long, vec array<double>")
    probes = spark.createDataFrame([(int(i), P[i].tolist(), int(i * 7)) for i in range(9)],
                                   "pid long, vec array<double>, ex long")
    return Tm, P, corpus, probes


def collect(df):
    out = {}
    for r in df.orderBy("pid", "rank").collect():
        out.setdefault(r["pid"], []).append((r["id"], round(r["score"], 9)))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_topk_matches_bruteforce(spark, data, parts):
    Tm, P, corpus, probes = data
    got = collect(topk_dot(corpus.repartition(parts), "id", "vec", probes, ["pid"], "vec", 12))
    assert got == brute(P, list(range(9)), Tm, np.arange(300), 12)


def test_zero_probe_emits_k(spark, data):
    Tm, P, corpus, probes = data
    got = collect(topk_dot(corpus.repartition(5), "id", "vec", probes, ["pid"], "vec", 4))
    assert got[3] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]


def test_exclusion_and_chunks(spark, data):
    Tm, P, corpus, probes = data
    got = collect(topk_dot(corpus, "id", "vec", probes, ["pid"], "vec", 5, exclude_col="ex",
                           max_probe_bytes=300))
    assert got == brute(P, list(range(9)), Tm, np.arange(300), 5, excl=[i * 7 for i in range(9)])


def test_full_ranking(spark, data):
    Tm, P, corpus, probes = data
    r = topk_dot(corpus, "id", "vec", probes.where(F.col("pid") < 2), ["pid"], "vec", None)
    got = collect(r)
    assert got == brute(P[:2], [0, 1], Tm, np.arange(300), 300)


@pytest.mark.parametrize("budget", [300, 1 << 20])
def test_known_dim_paths(spark, data, budget):
    Tm, P, corpus, probes = data
    got = collect(topk_dot(corpus, "id", "vec", probes, ["pid"], "vec", 6, dim=16, max_probe_bytes=budget))
    assert got == brute(P, list(range(9)), Tm, np.arange(300), 6)


def test_many_probes_stay_off_the_driver(spark):
    rng = np.random.default_rng(2)
    Tm, P = rng.normal(size=(60, 4)), rng.normal(size=(10_500, 4))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Tm)], "id long, vec array<double>")
    probes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(P)], "pid long, vec array<double>")
    df = topk_dot(corpus, "id", "vec", probes, ["pid"], "vec", 2, dim=4, max_probe_bytes=4 * 8 * 2000)
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().toString()
    got = collect(df)
    want = brute(P, list(range(10_500)), Tm, np.arange(60), 2)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}


def test_vectors_must_be_finite(spark, data):
    bad = spark.createDataFrame([(1, [float("nan")] * 16)], "id long, vec array<double>")
    with pytest.raises(Exception, match="finite"):
        topk_dot(bad, "id", "vec", data[3], ["pid"], "vec", 1).collect()


def test_global_rank_with_payload(spark):
    """Ranks stay dense when columns ride along and the result is read in several ways."""
    from semdex.operators.ordering import with_global_rank
    n = 1_200_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    ranked = with_global_rank(df, [F.col("k").asc()], num_partitions=24)
    r = ranked.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
    assert tuple(r) == (n, 0, n - 1)
    first = ranked.where("rank < 3").orderBy("rank").select("k").collect()
    assert [x["k"] for x in first] == [x["k"] for x in df.orderBy("k").limit(3).select("k").collect()]


def test_neighbours_scale_the_vectors_of_queries_alone(spark, monkeypatch):
    """the words that are no query are not scaled for the probes; results are those of plain cosines."""
    from semdex.operators import rank
    seen, kernel = [], rank.topk_dot

    def topk(corpus, key, vec, probes, *args, **named):
        seen.append(probes._jdf.queryExecution().optimizedPlan().toString())
        return kernel(corpus, key, vec, probes, *args, **named)

    monkeypatch.setattr(rank, "topk_dot", topk)
    words = spark.createDataFrame([(0, "a", [3.0, 4.0]), (1, "b", [0.0, 2.0]), (2, "c", [5.0, 0.0]), (3, "z", [0.0, 0.0])],
                                  "rank long, term string, vec array<double>")
    queries = spark.createDataFrame([(7, "a"), (8, "none"), (9, "z")], "query_id long, query string")
    got = rank.nearest_terms(words, queries, topn=2).orderBy("query_id", "nb_rank").collect()
    assert [(r["query_id"], r["term"], r["raw_score"]) for r in got] == [(7, "b", 0.8), (7, "c", 0.6), (9, "a", 0.0), (9, "b", 0.0)]
    below = seen[0].split("Join", 1)
    assert "aggregate(" in below[0] and "aggregate(" not in below[1]
