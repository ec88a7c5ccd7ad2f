"""C1, C5-C7 on the reference's own column fixture, and greedy vs brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from semdex.operators import columns as C
from semdex.operators.encode import encode_columns

STATS = [("col_a", 0.1, 100), ("col_b", 0.9, 2), ("col_c", 0.0, 500), ("col_d", 0.2, 20)]


def py_fitness(q, V, qual, mask):
    idx = [i for i in range(len(V)) if mask[i]]
    if not idx:
        return 0.0
    m = V[idx].mean(axis=0)
    d = np.linalg.norm(q) * np.linalg.norm(m)
    sem = 0.0 if d == 0 else float(q @ m) / d
    return 0.7 * sem + 0.2 * float(np.mean(qual[idx])) + 0.1 / (1 + len(idx))


def make_tables(spark, V, stats, table="t"):
    cols = spark.createDataFrame([(table, i, n, V[i].tolist(), nf, dc) for i, (n, nf, dc) in enumerate(stats)],
                                 "table_name string, ord long, name string, vec array<double>, "
                                 "null_fraction double, distinct_count long")
    return C.table_arrays(cols)


def make_tc(spark, q, V, stats, table="t"):
    qv = spark.createDataFrame([(1, q.tolist())], "query_id long, qvec array<double>")
    pairs = spark.createDataFrame([(1, table)], "query_id long, table_name string")
    return C.table_columns(pairs, make_tables(spark, V, stats, table), qv)


def masks(spark, n, table="t"):
    """Every non-empty subset, by bit mask."""
    rows = [(table, m, [i for i in range(n) if m >> i & 1]) for m in range(1, 1 << n)]
    return spark.createDataFrame(rows, "table_name string, subset_id long, members array<int>")


@pytest.fixture(scope="module")
def fixture():
    rng = np.random.default_rng(11)
    q = rng.random(768)
    V = rng.random((4, 768))
    V[2] = q + rng.normal(0, 0.1, 768)
    qual = np.array([(1 - nf) * (1 - 1 / dc) for _, nf, dc in STATS])
    return q, V, qual


def test_subset_fitness_and_best(spark, fixture):
    q, V, qual = fixture
    tc = make_tc(spark, q, V, STATS)
    scored = C.subset_scores(tc, make_tables(spark, V, STATS), masks(spark, 4))
    scores = {r["subset_id"]: r["fitness"] for r in scored.collect()}
    for mask in range(1, 16):
        bits = [(mask >> i) & 1 for i in range(4)]
        assert scores[mask] == pytest.approx(py_fitness(q, V, qual, bits), abs=1e-9)
    assert scores[0b0101] > scores[0b0010] > 0  # {a, c} beats {b}
    best = C.best_subsets(scored).first()["subset_id"]
    assert best & 0b0100 and not best & 0b0010


@pytest.mark.parametrize("n", [1, 2, 14, 40])
def test_greedy_steps(spark, n):
    """One algorithm for every width: the best column is added while the fitness grows."""
    rng = np.random.default_rng(5)
    q, V = rng.normal(size=32), rng.normal(size=(n, 32))
    stats = [(f"c{i}", float(rng.random() * 0.5), int(rng.integers(0, 50))) for i in range(n)]
    qual = np.array([(1 - nf) * (1 - 1 / (dc if dc else 1)) for _, nf, dc in stats])
    got = C.select_columns(make_tc(spark, q, V, stats)).first()
    chosen, best = [], 0.0
    while len(chosen) < n:
        f, j = max(((py_fitness(q, V, qual, [i in chosen or i == j for i in range(n)]), -j) for j in range(n) if j not in chosen))
        if not f > best:
            break
        chosen.append(-j)
        best = f
    assert got["fitness"] == pytest.approx(best, abs=1e-9)
    assert got["selected"] == [f"c{i}" for i in sorted(chosen)]
    if n <= 14:
        brute = max(py_fitness(q, V[:8], qual[:8], m) for m in itertools.product([0, 1], repeat=min(n, 8)))
        assert C.select_columns(make_tc(spark, q, V[:8], stats[:8])).first()["fitness"] <= brute + 1e-9


def test_ties_go_to_the_first_column(spark):
    V = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    got = C.select_columns(make_tc(spark, np.array([1.0, 0.0]), V, [("a", 0.0, 5), ("b", 0.0, 5), ("c", 0.0, 5)])).first()
    assert got["selected"] == ["a"]


@pytest.mark.parametrize("n", [1, 5, 30])
def test_runs_of_columns(spark, n):
    """Prefix sums give what every subset's own sum gives; also where columns have no vector."""
    from semdex.plans.registry import _rule_runs
    rng = np.random.default_rng(n)
    q, V = rng.normal(size=16), rng.normal(size=(n, 16))
    V[::4] = 0.0
    stats = [(f"c{i}", float(rng.random()), int(rng.integers(1, 50))) for i in range(n)]
    qual = np.array([(1 - nf) * (1 - 1 / dc) for _, nf, dc in stats])
    tables = make_tables(spark, V, stats)
    got = {r["subset_id"]: r for r in C.run_scores(make_tc(spark, q, V, stats), C.column_runs(tables, _rule_runs())).collect()}
    want = {}
    for i in range(n):
        want |= {i: {i}, 1000000 + i: set(range(i + 1)), 2000000 + i: set(range(n)) - {i}}
    want = {k: s for k, s in want.items() if s}
    assert got.keys() == want.keys()
    for k, s in want.items():
        assert got[k]["k"] == len(s) and got[k]["fitness"] == pytest.approx(py_fitness(q, V, qual, [i in s for i in range(n)]), abs=1e-9)


def test_rows_hold_no_square_matrix(spark, fixture):
    q, V, _ = fixture
    tc = make_tc(spark, q, V, STATS)
    assert {f.name for f in tc.schema if f.dataType.simpleString() == "array<array<double>>"} == {"vecs"}
    assert len(tc.first()["vecs"]) == 4 and "gram" not in tc.columns


def test_quality_defaults(spark):
    df = spark.createDataFrame([(None, None), (0.5, 0), (0.25, 4)], "nf double, dc long")
    got = [r["q"] for r in df.select(C.quality(F.col("nf"), F.col("dc")).alias("q")).collect()]
    assert got == [0.0, 0.0, 0.75 * 0.75]


def test_column_text_with_description(spark):
    wv = spark.createDataFrame([(0, "idade", [1.0, 0.0]), (1, "paciente", [0.0, 1.0])],
                               "rank long, term string, vec array<double>")
    cols = spark.createDataFrame([("coluna_idade", "idade do paciente"), ("coluna_teste_3", None)],
                                 "name string, description string")
    got = {r["name"]: r["vec"] for r in encode_columns(cols, wv, 2, description_col="description").collect()}
    # "coluna_idade. idade do paciente" -> tokens idade, idade, paciente in the vocabulary
    assert got["coluna_idade"] == pytest.approx([2 / 3, 1 / 3])
    assert got["coluna_teste_3"] == [0.0, 0.0]


def test_sketch_profile_close_to_exact(spark):
    from conftest import SF001
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    exact = {r["column"]: r["distinct_count"] for r in C.column_profile(li, "lineitem").collect()}
    approx = {r["column"]: r["distinct_count"] for r in C.column_profile(li, "lineitem", exact=False).collect()}
    assert exact.keys() == approx.keys()
    for c, n in exact.items():
        assert abs(approx[c] - n) <= max(2, 0.05 * n), c


@pytest.mark.parametrize("n", [1, 4, 10])
def test_floating_is_between_greedy_and_the_best_subset(spark, n):
    """Never below forward selection, never above the best of all subsets, and no flip of one column helps."""
    for seed in range(2):
        rng = np.random.default_rng(100 * n + seed)
        q, V = rng.normal(size=6), rng.normal(size=(n, 6))
        V[1::5] = 0.0
        stats = [(f"c{i}", float(rng.random()), int(rng.integers(0, 50))) for i in range(n)]
        qual = np.array([(1 - nf) * (1 - 1 / (dc if dc else 1)) for _, nf, dc in stats])
        tc = make_tc(spark, q, V, stats)
        greedy, got = C.select_columns(tc).first(), C.float_columns(tc).first()
        mask = [f"c{i}" in got["selected"] for i in range(n)]
        assert got["fitness"] == pytest.approx(py_fitness(q, V, qual, mask), abs=1e-9)
        every = [py_fitness(q, V, qual, m) for m in itertools.product([False, True], repeat=n)]
        assert greedy["fitness"] - 1e-9 <= got["fitness"] <= max(every) + 1e-9
        for i in range(n):
            flip = [m != (j == i) for j, m in enumerate(mask)]
            assert py_fitness(q, V, qual, flip) <= got["fitness"] + 1e-9


def test_floating_drops_a_column(spark):
    """The first column is the best alone, but the two others together are better without it."""
    V = np.array([[1.0, 1.0, 0.9], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])
    q, stats = np.array([1.0, 1.0, 0.0]), [("a", 0.0, 900), ("b", 0.0, 900), ("c", 0.0, 900)]
    tc = make_tc(spark, q, V, stats)
    assert C.select_columns(tc).first()["selected"] == ["a", "b", "c"]
    assert C.float_columns(tc).first()["selected"] == ["b", "c"]


@pytest.mark.parametrize("select", [C.select_columns, C.float_columns])
def test_conditions_on_a_selection_stay_above_it(spark, select):
    # below it each lambda of the selection would compute the arrays that it reads, all columns for every column
    rng = np.random.default_rng(9)
    done = select(make_tc(spark, rng.normal(size=4), rng.normal(size=(4, 4)), STATS))
    for asked in (done.where(F.size("selected") > 0), done.select("query_id", F.posexplode("selected"))):
        assert "lambda" not in asked._jdf.queryExecution().optimizedPlan().toString()
        assert asked.count() >= 1
