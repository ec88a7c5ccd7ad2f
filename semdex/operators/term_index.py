"""R3, approximate: nearest terms through random-projection buckets, re-ranked exactly.

Every row of the vector store is indexed: its unit vector, less the mean of all
rows, falls on one side of each of ``bits`` random planes, and the signs are its
bucket. A query looks into the ``n_probes`` buckets that cost it least, where a
bucket costs the sum of the squared distances to the planes that part it from
the query. Rows found are scored and ranked as the exact path does, so a term
found has the exact path's score; only terms in other buckets can be missed.

``fit_probes`` chooses ``n_probes``: for at most ``SAMPLE`` queries the exact
neighbours are searched in all rows, and the least number of buckets is taken
that holds ``recall`` of them. Vectors without structure make it approach the
number of buckets, which is the exact search. There is no limit on a bucket's
rows or queries: all rows and all queries are cut into blocks, whatever their
buckets, and a task meets one block of each. A query is sent once to a block of
rows, with the cost that its dearest bucket has, and the task finds the buckets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semdex.functions.vectors import with_l2_normalized
from semdex.operators.rank import _BLOCK_CELLS, _matrix, _TopK, cells, topk_dot
from semdex.session import materialize

MAX_BITS = 16           # at most 65,536 buckets: tables of a row a bucket may be broadcast
BUCKET_ROWS = 64        # rows a bucket holds on average, until MAX_BITS is reached
BLOCK_ROWS, BLOCK_PROBES = 1 << 18, 1 << 15      # rows and queries that one task holds
SAMPLE = 256            # queries that the number of buckets is fitted on
_HITS = "query_id long, rank long, raw_score double"


@dataclass(frozen=True)
class TermIndex:
    rows: DataFrame | None  # (rank, term, vec, code): every row of the store, unit vectors
    planes: np.ndarray      # bits x dim
    centre: np.ndarray      # the mean unit vector

    @property
    def bits(self) -> int:
        return self.planes.shape[0]

    def margins(self, X: np.ndarray) -> np.ndarray:
        return (X - self.centre) @ self.planes.T if X.shape[0] else np.zeros((0, self.bits))


def _codes(margins: np.ndarray) -> np.ndarray:
    return (margins > 0) @ (1 << np.arange(margins.shape[1], dtype=np.int64))


def bucket_order(margins: np.ndarray, n_probes: int) -> np.ndarray:
    """One query's ``n_probes`` cheapest buckets, cheapest first.

    The cheapest sets of the first j planes consist of cheapest sets of the
    first j - 1 planes, so the list never needs more than ``n_probes`` entries.
    """
    cost, flips = np.zeros(1), np.zeros(1, dtype=np.int64)
    for j, m in enumerate(margins):
        cost = np.concatenate([cost, cost + m * m])
        flips = np.concatenate([flips, flips | (1 << j)])
        keep = np.argsort(cost, kind="stable")[:n_probes]
        cost, flips = cost[keep], flips[keep]
    return _codes(margins[None, :])[0] ^ flips


def build_index(word_vectors: DataFrame, bits: int | None = None, seed: int = 17) -> TermIndex:
    """Index of all rows of (rank, term, vec); written once to the session's shared folder."""
    unit = with_l2_normalized(word_vectors.select("rank", "term", "vec"), "vec")
    # grouped, as the mean of no rows is an error
    total = unit.groupBy(F.lit(1)).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector("vec")).alias("mean")).first()
    n, centre = (total["n"], total["mean"].toArray()) if total else (0, np.zeros(1))
    if bits is None:
        bits = min(MAX_BITS, max(0, round(math.log2(max(n, 1) / BUCKET_ROWS))))
    planes = np.random.default_rng(seed).normal(size=(bits, len(centre)))
    planes /= np.linalg.norm(planes, axis=1, keepdims=True)
    margins_of = TermIndex(None, planes, centre).margins

    def assign(batches):
        for rb in batches:
            code = _codes(margins_of(_matrix(pa.Table.from_batches([rb]), "vec")))
            yield rb.append_column("code", pa.array(code, type=pa.int64()))

    rows = unit.mapInArrow(assign, "rank long, term string, vec array<double>, code long")
    return TermIndex(materialize(rows), planes, centre)


def _known(index: TermIndex, queries: DataFrame) -> DataFrame:
    word = index.rows.select(F.col("term").alias("query"), F.col("rank").alias("q_rank"), "vec")
    return queries.select("query_id", "query").join(word, "query").select("query_id", "q_rank", "vec")


def fit_probes(index: TermIndex, queries: DataFrame, topn: int = 300, recall: float = 0.95, sample: int = SAMPLE) -> int:
    """The least number of buckets that hold ``recall`` of the exact neighbours of ``sample`` queries.

    The queries are chosen by a hash of ``query_id``; at most sample x topn codes reach the driver.
    """
    spark = index.rows.sparkSession
    some = _known(index, queries).orderBy(F.xxhash64("query_id"), "query_id").limit(sample).toArrow()
    if not some.num_rows or not index.bits:
        return 1
    found = topk_dot(index.rows, "rank", "vec", spark.createDataFrame(some), ["query_id"], "vec", topn,
                     exclude_col="q_rank", rank_col="nb_rank")
    codes = found.join(index.rows.select("rank", "code"), "rank").select("query_id", "code").toPandas()
    at = []
    margins = dict(zip(some.column("query_id").to_pylist(), index.margins(_matrix(some, "vec"))))
    place = np.empty(1 << index.bits, dtype=np.int64)
    for query, of_query in codes.groupby("query_id")["code"]:
        place[bucket_order(margins[query], len(place))] = np.arange(len(place))
        at.append(place[of_query.to_numpy()])
    at = np.sort(np.concatenate(at)) if at else np.zeros(1, dtype=np.int64)
    return int(at[max(0, math.ceil(recall * len(at)) - 1)]) + 1


def nearest_terms_indexed(index: TermIndex, queries: DataFrame, topn: int = 300, n_probes: int | None = None,
                          block_rows: int = BLOCK_ROWS, block_probes: int = BLOCK_PROBES) -> DataFrame:
    """R3 through the index: (query_id, query, nb_rank, term, raw_score), as ``nearest_terms``.

    ``n_probes`` is fitted on the queries if it isn't given; the number of
    buckets makes the answer exact. Queries without a vector give no rows.
    """
    if n_probes is None:
        n_probes = fit_probes(index, queries, topn)
    n_probes = min(n_probes, 1 << index.bits)
    margins_of = TermIndex(None, index.planes, index.centre).margins
    bits = index.bits

    def reach(batches):
        for rb in batches:
            cost = []
            for m in margins_of(_matrix(pa.Table.from_batches([rb]), "vec")):
                last = bucket_order(m, n_probes)[-1] ^ _codes(m[None, :])[0]
                cost.append(float((last >> np.arange(bits) & 1) @ (m * m)))
            yield rb.append_column("reach", pa.array(cost, type=pa.float64()))

    probes = materialize(_known(index, queries).mapInArrow(
        reach, "query_id long, q_rank long, vec array<double>, reach double"))
    rows = index.rows.count()
    groups, blocks = cells(rows, probes.count(), 8 * len(index.centre), 24 * topn,
                           index.rows.sparkSession.sparkContext.defaultParallelism, block_probes)
    groups = max(groups, math.ceil(rows / block_rows))

    def spread(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)))
                  .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))))

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "rank", "raw_score"]
        out = pa.schema([("query_id", pa.int64()), ("rank", pa.int64()), ("raw_score", pa.float64())])
        if not rows.num_rows or not asked.num_rows:
            return out.empty_table()
        rows = rows.sort_by("code")
        code, rank, vecs, P = rows.column("code").to_numpy(), rows.column("rank").to_numpy(), _matrix(rows, "vec"), _matrix(asked, "vec")
        margins = margins_of(P)
        own, most = margins > 0, asked.column("reach").to_numpy()
        square = margins * margins
        # a bucket costs the squares of the planes on whose other side it lies: a sum that is linear in its bits
        base, slope = (own * square).sum(axis=1), np.where(own, -square, square)
        most = most + 1e-9 * (1.0 + square.sum(axis=1))
        first = np.flatnonzero(np.diff(code, prepend=-1))
        last = np.append(first[1:], len(code))
        top = _TopK(P, asked.column("q_rank").to_numpy(), topn)
        step = max(1, _BLOCK_CELLS // len(P))
        for at in range(0, len(first), step):
            signs = code[first[at:at + step], None] >> np.arange(bits) & 1
            near = base[:, None] + slope @ signs.T <= most[:, None]
            for i in range(near.shape[1]):
                asking, (lo, hi) = np.flatnonzero(near[:, i]), (first[at + i], last[at + i])
                if len(asking):
                    for _ in top.add(rank[lo:hi], vecs[lo:hi], asking):
                        pass
        if not top.pairs:
            return out.empty_table()
        found = top.batch(top.cand, {"query_id": asked.column("query_id").to_numpy()}, pa.int64(), names)
        return pa.Table.from_batches([found], schema=out)

    left = spread(index.rows.select("code", "rank", "vec"), "rank", "g", groups, "b", blocks).groupBy("g", "b")
    right = spread(probes, "query_id", "b", blocks, "g", groups).groupBy("g", "b")
    hits = left.cogroup(right).applyInArrow(cell, _HITS)
    w = Window.partitionBy("query_id").orderBy(F.col("raw_score").desc(), F.col("rank").asc())
    best = hits.withColumn("nb_rank", F.row_number().over(w).cast("bigint")).where(F.col("nb_rank") <= topn)
    return (best.join(index.rows.select("rank", "term"), "rank").join(queries.select("query_id", "query"), "query_id")
                .select("query_id", "query", "nb_rank", "term", "raw_score"))
