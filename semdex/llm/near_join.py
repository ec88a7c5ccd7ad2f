"""Operator 8: n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles (64-bit hashes). Documents
with equal sets form one class, and only classes are joined, so copies are never
paired. The shingles of a set are ordered by how many documents hold them, rare
ones first. Two sets of n and m shingles that link share at least t = 85 % of the
larger, hence at least l shingles within their first n - t + l and m - t + l: for
each class l is chosen by estimated cost, as a longer prefix meets more classes
but l shared shingles are asked of each. Two classes are a candidate if they
share as many prefix shingles as the smaller of their two l, and as many more as
their two sizes ask for (`needed_matches`).

* document frequencies: counted for all shingles of all documents, as sorted
  blocks of hash slots, delta-coded; the `frequent` most frequent slots (a fixed
  number) are broadcast as levels, the others count as rare. Any order is right.
* prefix lists: one shuffle by shingle; lists of at most `list_rows` classes give
  pairs; the pairs' shared shingles are counted. Longer lists are told by a window's
  count and pass through row by row; no task holds one whole.
* verification: candidate pairs and longer lists (passages that very many sets
  share) connect classes to families; a family is dealt into blocks of
  `block_rows` and `block_bytes` by hash, each pair of blocks a group, so that a set
  travels as often as its family has blocks, mostly once. The pairs of a group are
  compared there by matrix products, unless links found before connect both sides
  already, and no pair is ever a row. A group returns a spanning forest of its links. A family of more than `family_blocks` blocks, which would
  compare too many sets that share nothing, is verified list by list instead, by
  the same blocks.
* components: large-star / small-star rounds over the forests' edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semdex.llm._common import SPACES, delta_planes, from_delta_planes, join_groups, materialize, partitions, table

WORDS, PERCENT = 4, 85              # the query's contract
NEAR_WORDS, NEAR_PERCENT = 5, 80    # near duplicates in the pipeline
MAX_MATCH = 4
FREQUENT = 1 << 20
SLOT_BITS = 36
LIST_ROWS = 64
BLOCK_ROWS, BLOCK_BYTES = 2048, 32 << 20
BUCKET_WORDS = 1 << 22              # of the corpus, for each bucket of the frequency count
FAMILY_BLOCKS = 8
BROADCAST_ROWS = 1 << 20
VERIFY_COST = 8.0                   # of a candidate, against reading one list entry
FLUSH = 1 << 20
SEEN = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOT = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Text -> sorted distinct hashes of its word shingles."""

    def __init__(self, words: int):
        self.words = words
        self.powers = np.ones(1, np.uint64)

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8) if text else ()
        if not len(data):
            return np.empty(0, np.uint64)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        if not len(edge):
            return np.empty(0, np.uint64)
        size = edge[1::2] - edge[0::2]
        first = np.cumsum(size) - size
        letters = data[~space]
        place = np.arange(len(letters)) - np.repeat(first, size)
        longest = int(size.max())
        if longest > len(self.powers):
            self.powers = np.concatenate([self.powers[:1], np.cumprod(np.full(max(longest, 256) - 1, _ROOT, np.uint64))])
        w = self._mix(np.add.reduceat(_BYTE[letters] * self.powers[place], first) + size.astype(np.uint64))
        if len(w) < self.words:     # the whole sequence is the one shingle
            h = np.array([len(w)], np.uint64)
            for i in range(len(w)):
                h = self._mix(h * _ROOT + w[i:i + 1])
            return h
        n = len(w) - self.words + 1
        h = w[:n].copy()
        for j in range(1, self.words):
            h = h * _ROOT + w[j:n + j]
        return np.unique(self._mix(h))

    def class_id(self, shingles: np.ndarray) -> int:
        """64-bit hash of a set; the chance of any clash among a billion sets is 3 %."""
        spread = self._mix(shingles * _ROOT + np.uint64(len(shingles)))
        return int(self._mix(np.array([spread.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(spread >> np.uint64(7))]))[0].astype(np.int64))


def frequent_slots(docs: DataFrame, words: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots of the most frequent shingles and their levels (log2 of the
    number of documents), at most `frequent` of them, counted over all documents."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets, width = max(partitions(docs.sparkSession), size // (6 * BUCKET_WORDS)), -(-SLOT_BITS // 8)
    per = -(-(1 << SLOT_BITS) // n_buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(words), [], 0

        def flush() -> pa.RecordBatch:
            slots, n = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(slots, np.arange(1, n_buckets + 1, dtype=np.uint64) * np.uint64(per))
            cuts = [(b, s, e) for b, (s, e) in enumerate(zip([0, *ends[:-1]], ends)) if e > s]
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _, _ in cuts], pa.int32()),
                pa.array([delta_planes(slots[s:e], width) for _, s, e in cuts], pa.binary()),
                pa.array([np.minimum(n[s:e], 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes() for _, s, e in cuts], pa.binary())],
                names=["bucket", "slots", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                h = shingler(text)
                if len(h):
                    held.append(h >> np.uint64(64 - SLOT_BITS))
                    size += len(h)
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by bucket; a bucket is a fixed share of the slots
        bucket, slots, counts = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if not slots:
                return
            s, n = np.concatenate(slots), np.concatenate(counts)
            order = np.argsort(s, kind="stable")
            s, n = s[order], n[order]
            first = np.flatnonzero(np.diff(s, prepend=s[0] + np.uint64(1)))
            s, n = s[first], np.add.reduceat(n, first)
            hot = n >= 4
            level = np.log2(n[hot]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                pa.array([s[hot].astype("<u8").tobytes()], pa.binary()), pa.array([level.tobytes()], pa.binary()),
                pa.array([np.bincount(level, minlength=64).tolist()], pa.list_(pa.int64()))], names=["slots", "levels", "per_level"])

        for batch in batches:
            for b, s, n in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    yield from done()
                    bucket, slots, counts = b, [], []
                slots.append(from_delta_planes(s, width))
                counts.append(np.frombuffer(n, np.uint8).reshape(2, -1).T.copy().view("<u2").ravel().astype(np.int64))
        yield from done()

    blocks = docs.select("text").mapInArrow(count, "bucket int, slots binary, n binary")
    found = materialize(blocks.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
                        .mapInArrow(merge, "slots binary, levels binary, per_level array<long>"))
    per_level = found.select(F.posexplode("per_level").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()
    held = {r["level"]: r["n"] for r in per_level}
    least, total = 64, 0
    while least > 2 and total + held.get(least - 1, 0) <= frequent:
        least -= 1
        total += held.get(least, 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, lv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                level = np.frombuffer(lv, np.uint8)
                keep = level >= least
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(s, "<u8")[keep].tobytes()], pa.binary()),
                                                  pa.array([level[keep].tobytes()], pa.binary())], names=["slots", "levels"])

    rows = found.select("slots", "levels").mapInArrow(cut, "slots binary, levels binary").collect()
    slots = np.concatenate([np.frombuffer(r["slots"], "<u8") for r in rows] + [np.empty(0, np.uint64)])
    levels = np.concatenate([np.frombuffer(r["levels"], np.uint8) for r in rows] + [np.empty(0, np.uint8)])
    order = np.argsort(slots)
    return slots[order], levels[order]


def required(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def needed_matches(n: np.ndarray, match: np.ndarray, m: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """How many prefix shingles two sets of n and m share at least if they link.

    They share `both` in all. The common shingles up to where the prefix that ends
    first ends are in both prefixes, the others behind that end, where its set has
    required(n) - l left. Which prefix ends first is not known here: the larger rest
    counts. For sets of like size that is many more than the smaller l.
    """
    both = -(-percent * (n + m) // (100 + percent))
    rest = np.maximum(-(-percent * n // 100) - match, -(-percent * m // 100) - other)
    return np.maximum(np.minimum(match, other), both - rest).astype(np.int64)


def prefix(shingles: np.ndarray, slots: np.ndarray, levels: np.ndarray, percent: int,
           max_match: int = MAX_MATCH) -> tuple[np.ndarray, int]:
    """The prefix shingles of a set and its l."""
    n = len(shingles)
    level = np.zeros(n, np.uint8)
    if len(slots):
        slot = shingles >> np.uint64(64 - SLOT_BITS)
        at = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
        level = np.where(slots[at] == slot, levels[at], 0).astype(np.uint8)
    order = np.lexsort((shingles, level))
    t = required(n, percent)
    base, most = n - t + 1, min(max_match, t)
    met = np.cumsum((1 << level[order[:base + most - 1]].astype(np.int64)) - 1)     # list entries met, if frequencies are as estimated
    cost = [met[base + k - 2] * (1 + VERIFY_COST / k) for k in range(1, most + 1)]   # each candidate takes k of them
    match = int(np.argmin(cost)) + 1
    return shingles[order[:base + match - 1]], match


def _runs(batches: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Numeric columns of sorted batches, cut so that a run of equal first values is never parted."""
    held = None
    for now in batches:
        if not len(now[0]):
            continue
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now))
        last = np.searchsorted(now[0], now[0][-1], side="left")
        yield tuple(x[:last] for x in now)
        held = tuple(x[last:] for x in now)
    if held is not None:
        yield held


def _list_pairs(list_rows: int, percent: int):
    """Sorted (token, cid, n, match, size: the list's length) -> candidate pairs of short lists, members of long ones."""
    corner = {}
    names = ["token", "a", "b", "n", "need"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_: list[pa.RecordBatch] = []

        def short() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                token, cid, n, match, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "cid", "n", "match", "size"))
                at = size > list_rows
                if at.any():
                    long_.append(pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(cid[at]), pa.nulls(int(at.sum()), pa.int64()),
                                                             pa.array(n[at]), pa.array(size[at])], names=names))
                yield tuple(x[~at] for x in (token, cid, n, match))

        for token, cid, n, match in _runs(short()):
            yield from long_
            long_.clear()
            if not len(token):
                continue
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(first, len(token)))
            for s in np.unique(size):
                if s == 1:
                    continue
                rows = first[size == s][:, None] + np.arange(s)
                if s not in corner:
                    corner[s] = np.triu_indices(s, 1)
                x, y = rows[:, corner[s][0]].ravel(), rows[:, corner[s][1]].ravel()
                near = np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
                x, y = x[near], y[near]
                yield pa.RecordBatch.from_arrays([
                    pa.array(token[x]), pa.array(np.minimum(cid[x], cid[y])), pa.array(np.maximum(cid[x], cid[y])),
                    pa.nulls(len(x), pa.int64()), pa.array(needed_matches(n[x], match[x], n[y], match[y], percent))], names=names)
        yield from long_

    return pairs


class Forest:
    """Trees that links connect; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, xs: np.ndarray, ys: np.ndarray) -> None:
        for x, y in zip(xs.tolist(), ys.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def one_tree(self, *members: np.ndarray) -> bool:
        return len({self.root(x) for some in members for x in some.tolist()}) == 1

    def edges(self) -> list[tuple[int, int]]:
        """(member, root) of every tree of more than one member."""
        return [(x, self.root(x)) for x in range(len(self.parent)) if self.root(x) != x]


def link(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, high: int = 512) -> tuple[Forest, int]:
    """The forest of the links between `left` and `right` (or within `left`, if they are one array) and
    how many pairs were compared, by products of 0/1 blocks over the shingles that more than one of the
    sets holds. Sets come in the order of their sizes: blocks that lie near each other go first, those too
    different in size are left out, and so are those that one tree holds already."""
    forest, compared = Forest(len(sets)), 0
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    token, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    number = np.cumsum(held > 1) - 1
    row, column = row[shared], number[column[shared]]
    width, step = int((held > 1).sum()), 4096
    del token
    places = [(i, j) for i in range(0, len(left), high) for j in range(0, len(right), high) if left is not right or i <= j]
    for i, j in sorted(places, key=lambda p: (abs(p[0] - p[1]), p)):
        a, b = left[i:i + high], right[j:j + high]
        if size[a].max() * 100 < size[b].min() * percent or size[b].max() * 100 < size[a].min() * percent or forest.one_tree(a, b):
            continue
        compared += len(a) * len(b)
        both = np.zeros((len(a), len(b)), np.float32)
        for c in range(0, width, step):
            inside = (column >= c) & (column < c + step)
            blocks = []
            for rows in (a, b):
                place = np.full(len(sets), -1, np.int64)
                place[rows] = np.arange(len(rows))
                use = inside & (place[row] >= 0)
                block = np.zeros((len(rows), min(step, width - c)), np.float32)
                block[place[row[use]], column[use] - c] = 1
                blocks.append(block)
            both += blocks[0] @ blocks[1].T
        same = both.astype(np.int64)
        x, y = np.nonzero(same * 100 >= (size[a][:, None] + size[b][None, :] - same) * percent)
        forest.add(a[x], b[y])
    return forest, compared


def _verify(percent: int):
    """Sorted (token, first, second, block, cid, set) -> links, a spanning forest of each group."""
    def check(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for block, cid, data in rows:
            seen.setdefault((cid, block), np.frombuffer(data, "<u8"))
        keys = sorted(seen, key=lambda k: (len(seen[k]), k))
        if len(keys) < 2:
            return
        block = np.array([b for _, b in keys])
        low = np.flatnonzero(block == block.min())
        high = np.flatnonzero(block != block.min())
        trees = link([seen[k] for k in keys], low, high if len(high) else low, percent)[0].edges()
        if trees:
            yield pa.RecordBatch.from_arrays([pa.array([keys[x][0] for x, _ in trees], pa.int64()),
                                              pa.array([keys[y][0] for _, y in trees], pa.int64())], names=["u", "v"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            token, first, second, block, cid, data = (c.to_pylist() for c in batch.columns)
            for key, row in zip(zip(token, first, second), zip(block, cid, data)):
                if key != group:
                    yield from check(rows)
                    group, rows = key, []
                rows.append(row)
        yield from check(rows)

    return verify


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (u, v): the smallest node it reaches.
    Large-star / small-star rounds; their number grows with the logarithm of a component."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small)


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
              percent: int = PERCENT, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS,
              family_blocks: int = FAMILY_BLOCKS, frequent: int = FREQUENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_shingles, component_id, root.

    Two rows link if 100 * common shingles >= percent * united shingles, words
    being `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lower-cased; a text of
    fewer words than a shingle is one shingle. Null, empty and blank texts link
    with nothing and are their own component. component_id is the smallest
    identifier reachable; a null identifier counts only where no other is in the
    component. Rows that repeat an identifier are documents of their own, so the
    component itself is known by root, 64 bits, null for texts without shingles.
    The set of a very long text is held whole by the tasks that compare it. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_hash"),
                pa.array([shingler.class_id(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "text_hash", "cid", "n_shingles"])

    classed = materialize(rows.withColumn("text_hash", F.xxhash64("text"))
                          .mapInArrow(classify, f"doc_id {kind}, text_hash long, cid long, n_shingles long"))
    classes = materialize(classed.where("cid IS NOT NULL").groupBy("cid")
                          .agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles")))

    shared = spark.sparkContext.broadcast(frequent_slots(rows, words, frequent))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (slots, levels), seen = Shingler(words), shared.value, set()
        for batch in batches:
            tokens, cids, ns, matches = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler(text)
                cid = shingler.class_id(s) if len(s) else None
                if cid is None or cid in seen:
                    continue
                if len(seen) < SEEN:        # spares copies; those beyond it meet in the shuffle
                    seen.add(cid)
                head, match = prefix(s, slots, levels, percent)
                tokens.append(head)
                cids.append(np.full(len(head), cid, np.int64))
                ns.append(np.full(len(head), len(s), np.int64))
                matches.append(np.full(len(head), match, np.int64))
            if tokens:
                token = np.concatenate(tokens).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(np.concatenate(cids)),
                     pa.array(np.concatenate(ns) << 3 | np.concatenate(matches))], names=["token", "cid", "n_match"])

    entries = (rows.select("text").mapInArrow(index, "token long, cid long, n_match long")
               .repartition(partitions(spark), "token").sortWithinPartitions("token", "cid"))
    # copies from several tasks lie next to each other here
    before = Window.partitionBy("token").orderBy("cid")
    entries = (entries.withColumn("again", F.coalesce(F.lag("cid").over(before) == F.col("cid"), F.lit(False))).where("NOT again")
               .select("token", "cid", F.shiftright("n_match", 3).alias("n"), F.col("n_match").bitwiseAND(7).alias("match"),
                       F.count(F.lit(1)).over(Window.partitionBy("token")).alias("size")))
    lists = materialize(entries.mapInArrow(_list_pairs(list_rows, percent), "token long, a long, b long, n long, need long"))

    pairs = (lists.where("b IS NOT NULL").groupBy("a", "b")
             .agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need"), F.min("token").alias("token"))
             .where("shared >= need"))
    pairs = materialize(pairs.select("a", "b", "token"))
    long_ = lists.where("b IS NULL").select("token", F.col("a").alias("cid"))
    family = materialize(components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        long_.select(F.col("token").alias("u"), F.col("cid").alias("v")))))
    short = pairs.select("token", F.explode(F.array("a", "b")).alias("cid")).distinct()
    in_list = short.unionByName(long_)
    kin = family.join(in_list.select(F.col("cid").alias("node")).distinct(), "node", "left_semi").select(
        "root", F.col("node").alias("cid")).join(classes.select("cid", "n_shingles"), "cid")
    dealt = (F.count(F.lit(1)).alias("size"),
             F.ceil(F.greatest(F.count(F.lit(1)) / block_rows, F.sum("n_shingles") * 8 / block_bytes)).cast("int").alias("blocks"))
    sizes = kin.groupBy("root").agg(*dealt)
    large = sizes.where(F.col("size") > family_blocks * block_rows).select("root")
    whole = kin.join(sizes.join(large, "root", "left_anti"), "root").select(F.col("root").alias("token"), "cid", "blocks")
    lists_of = in_list.join(kin.join(large, "root").select("cid", "n_shingles"), "cid")
    by_list = lists_of.join(lists_of.groupBy("token").agg(*dealt), "token").select("token", "cid", "blocks")
    blocks = F.col("blocks")
    members = materialize(
        whole.unionByName(by_list).withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("token", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "cid"))

    needed = materialize(members.select("cid").distinct().join(classes, "cid").select(F.col("first_id").alias("need_id")).distinct())
    side = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    texts = rows.join(side, F.col("doc_id").eqNullSafe(F.col("need_id")), "left_semi").select("text")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [s for s in (shingler(t) for t in batch.column("text").to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([shingler.class_id(s) for s in sets], pa.int64()),
                                              pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["cid", "set"])

    sets = texts.mapInArrow(resolve, "cid long, set binary").dropDuplicates(["cid"])
    links = (members.join(sets, "cid").select("token", "first", "second", "block", "cid", "set")
             .repartition(partitions(spark), "token", "first", "second").sortWithinPartitions("token", "first", "second")
             .mapInArrow(_verify(percent), "u long, v long"))
    roots = materialize(components(links).join(classes, F.col("node") == F.col("cid")).select("node", "root", "first_id"))
    smallest = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = roots.join(smallest, "root").select(F.col("node").alias("cid"), "root", "component_id")
    groups = materialize(classes.join(linked, "cid", "left")
                         .select("cid", "copies", F.coalesce("component_id", "first_id").alias("component_id"),
                                 F.coalesce("root", "cid").alias("root")))
    alone = classed.where("cid IS NULL").withColumns({"component_id": F.col("doc_id"), "root": F.col("cid")})
    joined = join_groups(classed.where("cid IS NOT NULL"), groups, "cid", "copies")
    columns = ["doc_id", "text_hash", "n_shingles", "component_id", "root"]
    return joined.select(*columns).unionByName(alone.select(*columns))


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_join(docs).select("doc_id", "n_shingles", "component_id")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest identifier stays;
    of rows that repeat it, the one with the smallest text hash. Rows without
    shingles are components of their own and all stay."""
    found = materialize(near_join(docs, words=NEAR_WORDS, percent=NEAR_PERCENT))
    keep = (found.where("root IS NOT NULL").groupBy("root")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("least"))
            .select(F.xxhash64("least.doc_id", "least.text_hash").alias("keep_key")))
    blank = F.trim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACES)) == ""
    # one 64-bit key for join and window, so that the texts are shuffled once
    kept = docs.where(~blank).select(F.struct("*").alias("row"), F.xxhash64("doc_id", F.xxhash64("text")).alias("keep_key")).join(keep, "keep_key")
    nth = F.row_number().over(Window.partitionBy("keep_key").orderBy(F.lit(1)))
    return kept.withColumn("nth", nth).where("nth = 1").select("row.*").unionByName(docs.where(blank))
