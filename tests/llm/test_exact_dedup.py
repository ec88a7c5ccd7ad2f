import hashlib

import pytest

from semdex.llm import exact_dedup
from .conftest import ODD


def brute(rows, keep):
    norm = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        best = (min if keep == "smallest" else max)(ids) if ids else None
        out.append((i, best, len(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()))
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hot_rows", [2, 256])
def test_odd_rows(documents, keep, hot_rows):
    rows = ODD + [(100 + i, "Copied text") for i in range(300)]
    got = exact_dedup.content_sort(documents(rows), keep=keep, hot_rows=hot_rows).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute(rows, keep), key=key)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_table(documents):
    assert exact_dedup.content_sort(documents([])).count() == 0


def test_stage_keeps_columns(spark, documents):
    docs = documents(ODD)
    kept = exact_dedup.dedup_stage(spark, docs, None)
    assert kept.columns == docs.columns
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = {}
    for i, t in ODD:
        groups.setdefault(lower(t), []).append(i)
    want = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = [(lower(r.text), r.doc_id) for r in kept.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_rows_without_identifier_spread(spark, documents):
    # a third of the rows has no identifier, or one that repeats, and one text
    rows = [(None, "Hot text")] * 1500 + [(5, "hot TEXT")] * 500 + [(None, "none here")] * 400 + [(i, f"text {i}") for i in range(10, 4000)]
    docs = documents(rows).repartition(12)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = exact_dedup.content_sort(docs, keep="largest", hot_rows=100)
    rows = got.collect()
    hot = [r for r in rows if r.group_size == 2000]
    assert len(hot) == 2000 and {r.keep_id for r in hot} == {5} and sum(r.kept for r in hot) == 1 and [r.doc_id for r in hot if r.kept] == [5]
    unnamed = [r for r in rows if r.group_size == 400]
    assert len(unnamed) == 400 and sum(r.kept for r in unnamed) == 1 and {r.keep_id for r in unnamed} == {None}
    assert sum(r.kept for r in rows) == 2 + 3990
    from pyspark.sql import functions as F
    n = int(before)
    runs = docs.where("lower(text) = 'hot text'").groupBy(F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(n))).count()
    assert runs.agg(F.max("count")).first()[0] < 1000


def test_splitters_are_bounded(spark, documents):
    plan = exact_dedup.content_sort(documents(ODD))._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
