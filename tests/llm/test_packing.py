import itertools
from zlib import crc32

import duckdb
import numpy as np
import pytest

from semdex.llm import packing
from .conftest import ODD

BLANKS = ["a  b", "a\n b", "x   y \n z", "  lead", "trail  ", " ", "  x", "it's  <|endoftext|> x", "a\0 b\0", "é à  ",
          "\x1c x", "a \t b", "don't\n\n\nnow 12 345", "a b", "w, (x) y!"]


def plain(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.tokenizer_path())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4") for x in texts]


def test_units_give_the_tokenizers_ids():
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()] + BLANKS
    ids = packing.DocumentIds(packing.tokenizer_path())
    for _ in range(2):
        assert list(ids.every(texts)) == [x.tobytes() for x in plain(texts)]


def test_chunks_and_full_memos_change_nothing(monkeypatch):
    for name, value in (("CHUNK_CHARS", 30), ("MEMO_UNITS", 3), ("MEMO_PARTS", 4), ("MEMO_CHARS", 5)):
        monkeypatch.setattr(packing, name, value)
    texts = [None, "", "one two one", "three  four", "unbelievably long-winded words", "one two", " x", *BLANKS] * 3
    ids = packing.DocumentIds(packing.tokenizer_path())
    assert list(ids.every(texts)) == [x.tobytes() for x in plain(texts)]
    assert len(ids.units) <= 3 and all(len(p) <= 5 for p in ids.parts)


@pytest.mark.parametrize("seed", range(4))
def test_differencing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 129, 700)
    window = packing.differencing(lengths, 1024)
    sums = np.bincount(window, lengths)
    assert sums.max() <= 1024 and len(sums) <= -(-lengths.sum() // 1024) + 1
    assert sums.max() - sums.min() <= 16


def test_window_count_rises():
    # three pieces of 600 can't share windows of 1024, though two would hold them by volume
    assert sorted(packing.differencing([600, 600, 600], 1024)) == [0, 1, 2]
    assert len(packing.differencing([], 1024)) == 0


def test_differencing_against_every_partition():
    lengths = [8, 7, 6, 5, 4]
    best = min(max(sum(x for x, w in zip(lengths, a) if w == k) for k in (0, 1)) for a in itertools.product((0, 1), repeat=5))
    _, sums = packing._difference(np.array(lengths), 2)
    assert max(sums) - best <= 1 and sums.sum() == 30


def test_pack(documents):
    rows = [*ODD, (7, "again " * 3000), (None, None)]
    got = packing.pack(documents(rows), packing.tokenizer_path()).toPandas()
    ids = {}
    for (i, *_), x in zip(rows, plain([t for _, t, *_ in rows])):
        ids.setdefault(i, []).append(np.append(x, np.uint32(0)).astype("<u4"))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.append(0, s.length.cumsum().to_numpy()[:-1])).all() and s.length.sum() <= 1024
    # every piece has the untouched tokenizer's ids, and the pieces of each identifier cover its documents once
    key = [None if x != x or x is None else int(x) for x in got.doc_id]
    assert got.length.sum() == sum(len(x) for xs in ids.values() for x in xs)
    for r, k in zip(got.itertuples(), key):
        assert any(len(x) == r.doc_tokens and crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[k])
    for i, xs in ids.items():
        mine = got[[k == i for k in key]]
        want = sorted((len(x), s, n) for x in xs for s, n in packing.cut(len(x)))
        assert sorted(zip(mine.doc_tokens, mine.start, mine.length)) == want


def test_rows_without_identifier_spread(documents):
    # a third of the rows has no identifier and one text: no group holds more than its share
    rows = [(None, "the same words again") for _ in range(2000)] + [(i, f"text number {i} of its own") for i in range(4000)]
    docs = documents(rows).repartition(5)
    got = packing.pack(docs, packing.tokenizer_path(), capacity=64, group_windows=8).toPandas()
    assert len(got) == 6000 and got.doc_id.isna().sum() == 2000
    per_group = got.groupby(got.sequence_id // 2 ** 32).size()
    assert len(per_group) > 30 and per_group.max() < 4 * per_group.mean()
    assert got.groupby("sequence_id").length.sum().max() <= 64


def test_large_identifiers_beside_null(documents):
    ids = [2 ** 62 + 1, None, -2 ** 60 - 3]
    got = packing.pack(documents([(i, "a b c") for i in ids]), packing.tokenizer_path()).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, ids))


def test_empty_table(documents):
    assert packing.pack(documents([]), packing.tokenizer_path()).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs, packing.tokenizer_path()).groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert (1024 * len(got) - got.sum()) / got.sum() < 0.01
