import numpy as np
import pytest

from semdex.llm import sharding
from .conftest import ODD


def claim(shards, size):
    """The turns played out over explicit preference lists."""
    orders = [[(sharding._number(s, "offset") + j * (1 + sharding._number(s, "skip") % (size - 1))) % size for j in range(size)]
              for s in shards]
    owner = {}
    while len(owner) < size:
        for i, order in enumerate(orders):
            free = next((x for x in order if x not in owner), None)
            if free is None:
                break
            owner[free] = i
    return [owner[x] for x in range(size)]


@pytest.mark.parametrize("n, size", [(1, 2), (3, 7), (5, 101), (16, 251)])
def test_table_is_claimed_in_turns(n, size):
    names = sharding.shard_names(n)
    assert sharding.lookup_table(names, size).tolist() == claim(names, size)


def test_balance_and_few_moves():
    names = sharding.shard_names(50)
    full = sharding.lookup_table(names)
    share = np.bincount(full)
    assert share.max() - share.min() <= 1
    less = sharding.lookup_table(names[:-1])
    stayed = full != 49
    assert (full[stayed] == less[stayed]).mean() > 0.9
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_place(documents):
    docs = documents(ODD)
    got = sharding.place(docs, "doc_id", ["a", "b", "c"], 101)
    rows = got.collect()
    assert len(rows) == len(ODD) and len({r.shard for r in rows if r.doc_id is None}) == 1
    table = sharding.lookup_table(["a", "b", "c"], 101)
    assert all(r.shard == "abc"[table[r.slot]] for r in rows)
    assert sharding.place(documents([]), "doc_id", ["a"], 101).count() == 0
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_write_shards(spark, documents, tmp_path):
    docs = documents(ODD).drop("slot")
    sharding.write_shards(docs, "text", ["a", "b"], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD) and set(docs.columns) < set(back.columns)
