from collections import defaultdict

from semdex.llm import mixing
from .conftest import ODD


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by repeated capping, as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] * (1 + 1e-12)]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def sources(n=400):
    rows = []
    for i in range(n):
        source = [None, "a", "b", "ä", "B", "tiny", "a"][i % 7]
        rows.append((i, "w " * (1 if source == "tiny" else (i * 37) % 90 + 1), source))
    return rows + [(None, "one two", "a"), (5, None, "b"), (5, None, "b"), (6, "", "only empty"), (9, "x y", "b"), (9, "x y", "b")]


def test_targets_and_taken(documents):
    rows = sources()
    got = mixing.mix_sources(documents(rows), fan_in=8).collect()
    assert len(got) == len(rows)
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    want = targets(dict(size))
    for r in got:
        assert r.source_size == size[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in size:
        assert abs(taken[s] - want[s]) <= max(1, largest[s] / 2), s
    assert abs(sum(want.values()) - sum(size.values())) < 1e-6


def test_reruns_agree(documents):
    docs = documents(sources())
    once = sorted(map(str, mixing.mix_sources(docs).collect()))
    assert once == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))


def test_expectation(documents):
    """Over seeds, a document is taken as often as its source's share says."""
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(60)]
    total, share, runs = defaultdict(float), {}, 12
    for seed in range(runs):
        for r in mixing.mix_sources(documents(rows), seed=seed).collect():
            total[r.source] += r.copies / runs
            share[r.source] = r.target / r.source_size
    for s in "ab":
        assert abs(total[s] / 30 - share[s]) < 0.25


def test_stage_repeats_rows(spark, documents):
    rows = sources(70) + ODD
    docs = documents([(*r, "s")[:3] for r in rows])
    out = mixing.mix_stage(spark, docs, None)
    assert out.columns == docs.columns
    mix = mixing.mix_sources(docs)
    assert out.count() == mix.groupBy().sum("copies").first()[0]


def test_rows_without_identifier_spread(spark, documents):
    """A third of the rows has no identifier and one text: no bucket gathers them, and the mix is whole."""
    from pyspark.sql import functions as F
    rows = [(None, "the same few words", "a")] * 2000 + [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(4000)]
    docs = documents(rows).repartition(5)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 6000
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)
    hot = [r.copies for r in got if r.doc_id is None]
    share = target["a"] / next(r.source_size for r in got if r.source == "a")
    assert len(hot) == 2000 and abs(sum(hot) / 2000 - share) < 0.1
    keyed = spark.range(2000).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("at"))
    assert keyed.groupBy(mixing._bucket(F.lit(32), 1, 7).alias("b")).count().agg(F.max("count")).first()[0] < 130


def test_empty_table(documents):
    assert mixing.mix_sources(documents([])).count() == 0
