import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from semdex.llm import near_join as nj
from .conftest import ODD

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def brute(rows, words, percent):
    """doc_id, n_shingles, component_id of every row, all pairs compared."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for held in holders.values():
        for a in range(len(held)):
            for b in range(a):
                common[held[b], held[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(b)] = root(a)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted((str(rows[i][0]), len(sets[i]), str(least[root(i)])) for i in range(len(rows)))


def answer(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def families(seed, n_families=12, near=30):
    """Families of near copies round the threshold, a passage that all share, exact copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for f in range(n_families):
        base = rng.choices(vocabulary, k=rng.randint(30, 160))
        for _ in range(near if f == 0 else rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words + passage
            rows.append((len(rows), " ".join(words).title() if rng.random() < 0.2 else " ".join(words)))
    rows += [(len(rows) + i, " ".join(passage) + f" end{i % 5}") for i in range(40)]
    return rows + [(len(rows) + i, rows[3][1]) for i in range(20)]


@pytest.mark.parametrize("words, percent, list_rows, block_rows, family_blocks", [
    (4, 85, 64, 2048, 8), (5, 80, 4, 7, 99), (4, 85, 3, 5, 99), (4, 85, 3, 5, 1), (5, 80, 64, 7, 0)])
def test_families(documents, words, percent, list_rows, block_rows, family_blocks):
    rows = families(percent + list_rows)
    docs = documents(rows).repartition(5)
    got = nj.near_join(docs, words=words, percent=percent, list_rows=list_rows, block_rows=block_rows, family_blocks=family_blocks, frequent=64)
    assert answer(got) == brute(rows, words, percent)


def test_odd_rows(documents):
    rows = ODD + [(30, "one two"), (31, "ONE  two"), (32, "one two three"), (None, "one\ttwo")]
    assert answer(nj.near_join(documents(rows))) == brute(rows, 4, 85)
    assert nj.near_join(documents([])).count() == 0


def test_whole_table(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = nj.op8_near_join(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert answer(got) == brute(rows, 4, 85)


def test_prefixes_share_enough():
    """Linked sets always share the smaller of their two l within their prefixes."""
    rng = np.random.default_rng(3)
    universe = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    slots = np.unique(universe[:3950] >> np.uint64(64 - nj.SLOT_BITS))
    levels = rng.integers(2, 12, len(slots)).astype(np.uint8)
    seen = set()
    for _ in range(300):
        a = np.unique(rng.choice(universe, rng.integers(1, 200)))
        drop = rng.integers(0, max(1, len(a) // 6) + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.choice(universe, rng.integers(0, 6))]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            (pa, la), (pb, lb) = (nj.prefix(x, slots, levels, 85) for x in (a, b))
            need = int(nj.needed_matches(*(np.array([x]) for x in (len(a), la, len(b), lb)), 85)[0])
            assert len(np.intersect1d(pa, pb)) >= need >= min(la, lb)
            seen.add(min(la, lb))
    assert len(seen) > 1


def test_frequent_slots(spark, documents):
    rows = [(i, f"the shared passage of words {i}") for i in range(40)] + [(99, "alone in the world of text")]
    slots, levels = nj.frequent_slots(documents(rows), 4)
    s = nj.Shingler(4)
    hot = {int(x) >> (64 - nj.SLOT_BITS) for x in s("the shared passage of words")}
    assert set(slots.tolist()) == hot and set(levels.tolist()) == {5}
    few, _ = nj.frequent_slots(documents(rows), 4, frequent=1)
    assert len(few) == 0


def test_shingles_by_hand():
    s = nj.Shingler(3)
    assert np.array_equal(s("a b c d"), s("A  B\tc\nD")) and len(s("a b c d")) == 2
    assert not np.array_equal(s("a b"), s("a b c")) and not np.array_equal(s("ab c"), s("a bc"))
    assert len(s("É b c")) == 1 and not np.array_equal(s("É b c"), s("é b c"))
    data = [nj.delta_planes(np.array(x, np.uint64), 5) for x in ([3, 9, 1 << 35], [0])]
    assert nj.from_delta_planes(data[0], 5).tolist() == [3, 9, 1 << 35] and nj.from_delta_planes(data[1], 5).tolist() == [0]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)] + [(5, 5)]
    got = {r.node: r.root for r in nj.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            x, y = want.setdefault(a, a), want.setdefault(b, b)
            for k in [k for k, v in want.items() if v in (x, y)]:
                want[k] = min(x, y)
    assert got == want
    assert nj.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stage_keeps_one_of_each_group(spark, documents):
    rows = families(7) + ODD
    docs = documents(rows)
    kept = nj.near_stage(spark, docs, None)
    assert kept.columns == docs.columns
    # by brute force: one row of each component that has shingles, and every blank row
    sets, texts = [nj.Shingler(5)(t) for _, t, *_ in rows], [t for _, t, *_ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both) > 0:
                root = [root[j] if r == root[i] else r for r in root]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    blank = [(i, t) for (i, t, *_), s in zip(rows, sets) if not len(s)]
    assert sorted(map(str, (g for g in got if not len(nj.Shingler(5)(g[1]))))) == sorted(map(str, blank))
    groups = {}
    for (i, t, *_), s, r in zip(rows, sets, root):
        if len(s):
            groups.setdefault(r, []).append((i, t))
    kept_of = [[g for g in members if g in got] for members in groups.values()]
    assert len(got) == len(groups) + len(blank) == 71 and all(kept_of)
    for members in groups.values():
        least = min((i for i, _ in members if i is not None), default=None)
        assert any((least, t) in got for _, t in members)


def test_stage_keeps_one_of_each_component(documents):
    """Identifiers that are null or repeated do not make rows one document."""
    rng = random.Random(11)
    long_ = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=60)) for _ in range(6)]
    rows = ODD + [(None, long_[0]), (None, long_[1]), (None, long_[2]), (None, long_[2] + " end"), (40, long_[3]), (40, long_[4]),
                  (None, long_[5]), (41, long_[5] + " end"), (None, None), (None, ""), (None, "")]
    got = nj.near_stage(None, documents(rows), None).collect()
    kept = sorted((str(r.doc_id), (r.text or "")[:200]) for r in got if (r.text or "").split())
    alone = [(None, "Élan vital 😀 déjà vu"), (6, "élan vital 😀 déjà vu"), (7, rows[9][1][:200]), (8, "x"), ODD[11], ODD[12], ODD[0]]
    once = [(None, long_[0]), (None, long_[1]), (40, long_[3]), (40, long_[4]), (41, long_[5] + " end")]
    either = [k for k in kept if k[1].startswith(long_[2][:200])]
    want = sorted((str(i), t[:200]) for i, t in alone + once)
    assert len(either) == 1 and either[0][0] == "None" and sorted(k for k in kept if k not in either) == want
    assert sorted(str(r.doc_id) for r in got if not (r.text or "").split()) == sorted(
        str(i) for i, t in rows if not (t or "").split())


def test_a_dense_group_is_linked_without_comparing_all_pairs():
    """Near copies of one text: once one tree holds them, blocks are left out; a forest, by brute force."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 200, dtype=np.uint64)
    sets = sorted((np.unique(np.append(base, rng.integers(0, 1 << 62, rng.integers(1, 12), dtype=np.uint64))) for _ in range(900)), key=len)
    every = np.arange(900)
    forest, compared = nj.link(sets, every, every, 85, high=30)
    assert len(forest.edges()) == 899 and compared < 900 * 900 / 8
    half = nj.link(sets, every[:450], every[450:], 85, high=30)[0]
    assert half.one_tree(every)


def test_link_against_all_pairs():
    rng = np.random.default_rng(4)
    sets = sorted((np.unique(rng.integers(0, 60, rng.integers(20, 60), dtype=np.uint64)) for _ in range(200)), key=len)
    forest = nj.link(sets, np.arange(200), np.arange(200), 70, high=16)[0]
    root = list(range(200))
    for i in range(200):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * 100 >= 70 * (len(sets[i]) + len(sets[j]) - both):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert [forest.root(x) for x in range(200)] == root and len(set(root)) > 5


def test_a_common_passage_makes_no_candidates(spark, documents):
    """A third of the documents holds one passage, each has words of its own: few pairs are candidates."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join([passage] * (i % 3 == 0) + [f"o{rng.randrange(10 ** 9)}" for _ in range(40)])) for i in range(3000)]
    docs = documents(rows)
    slots, levels = nj.frequent_slots(docs, 4)
    lists = defaultdict(list)
    for i, t in rows:
        head, match = nj.prefix(nj.Shingler(4)(t), slots, levels, 85)
        for x in head.tolist():
            lists[x].append(i)
    assert sum(len(x) * (len(x) - 1) // 2 for x in lists.values()) < 3000 and max(map(len, lists.values())) < 50
    got = nj.near_join(docs).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 3000


def test_blocks_by_bytes_and_short_lists_give_the_same(documents):
    rows = families(9)
    docs = documents(rows)
    assert answer(nj.near_join(docs, block_bytes=4000, list_rows=3, family_blocks=2, block_rows=7)) == brute(rows, 4, 85)
