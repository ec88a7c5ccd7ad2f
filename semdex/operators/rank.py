"""Similarity ranking (R1-R5) as one distributed block multiply.

Plan shape for ``topk_dot(corpus, probes, k)`` with few probes:

    corpus scan -> mapInArrow(block multiply + local top-k)   (no shuffle)
                -> exchange on probe key (probes x k x partitions rows)
                -> window row_number <= k                     (WindowGroupLimit)

The probe side (query vectors, one row per query or per candidate weight
vector) is fetched and broadcast only within ``max_probe_bytes``, which is
checked. Beyond it nothing goes through the driver: probes are hashed to blocks
that each fit, corpus rows to groups, and a cogroup multiplies every pair of
block and group in a task of its own; a probe then meets each group once. The
groups are as few as sizes and cores allow, as each hands on k rows of a probe.
Scores are rounded to 10 places before they are ranked, so equal vectors tie
wherever they are multiplied, and ties go to the smaller corpus key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semdex.functions.vectors import with_l2_normalized
from semdex.operators.ordering import with_global_rank
from semdex.session import materialize

DEFAULT_MAX_PROBE_BYTES = 64 << 20
# Fixed value: what a ranked key without an entry is called.
UNKNOWN_KEY = "ID_%s_DESCONHECIDO"
_BLOCK_CELLS = 1 << 22  # scores held at once per task (32 MiB of doubles)
_BLOCK_ROWS = 2048      # corpus rows multiplied at once
_RANKED_CELLS = 1 << 19     # scores handed on at once, where all are
_RANKED_SIDE = 1024     # rows and probes of one task's work, where all its scores are its result
_EXACT_PAIRS = 1 << 16  # pairs multiplied in double precision at once
_CELL_BYTES = 128 << 20     # corpus rows that one task holds beside its probes
_NOT_FINITE = "a score is not a number: vectors must be finite"


def _as_matrix(col: pa.Array, n: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if n == 0:
        return np.zeros((0, 0))
    offsets = np.asarray(col.offsets)
    lens = np.diff(offsets)
    if lens.min() != lens.max():
        raise ValueError("vectors of different lengths in one batch")
    values = col.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, int(lens[0]))


SCORE_PLACES = 10


class _TopK:
    """Scores of probes against blocks of corpus rows; keeps the best ``k`` per probe.

    A block is multiplied in single precision first. Only pairs that reach the probe's k-th best
    score so far, less a bound of that product's error, are multiplied in double precision, so what
    is kept is exact. Pairs wait in a buffer of about ``k`` per probe before they are ranked.
    """

    def __init__(self, P: np.ndarray, excl, k: int | None):
        self.P, self.excl, self.k = P, excl, k
        if not np.isfinite(P).all():
            raise ValueError(_NOT_FINITE)
        self.norms = np.sqrt(np.einsum("ij,ij->i", P, P))
        self.least = np.full(P.shape[0], -np.inf)   # of each probe the k-th best score, and its key
        self.last = None
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pairs = 0

    def add(self, keys: np.ndarray, Tm: np.ndarray, rows: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        """Takes a block in, for the probes ``rows`` (default: all); without ``k`` yields its scores (q, key, s) at once."""
        if Tm.shape[1] != self.P.shape[1]:
            raise ValueError(f"dimension mismatch: corpus {Tm.shape[1]} vs probes {self.P.shape[1]}")
        if not np.isfinite(Tm).all():
            raise ValueError(_NOT_FINITE)
        if self.k is None:
            width = min(max(self.P.shape[0], 1), _RANKED_CELLS)
            step = max(1, _RANKED_CELLS // width)
            for lo in range(0, len(keys), step):
                kb, T = keys[lo:lo + step], Tm[lo:lo + step].T
                for at in range(0, self.P.shape[0], width):
                    S = np.round(self.P[at:at + width] @ T, SCORE_PLACES) + 0.0
                    if not np.isfinite(S).all():
                        raise ValueError(_NOT_FINITE)
                    if self.excl is not None:
                        S[self.excl[at:at + width, None] == kb[None, :]] = -np.inf
                    qi, tj = np.nonzero(np.isfinite(S))
                    yield pd.DataFrame({"q": at + qi, "key": kb[tj], "s": S[qi, tj]})
            return
        probes = np.arange(self.P.shape[0]) if rows is None else rows
        for lo in range(0, len(keys), _BLOCK_ROWS):
            kb, T = keys[lo:lo + _BLOCK_ROWS], Tm[lo:lo + _BLOCK_ROWS]
            step = max(1, _BLOCK_CELLS // len(kb))
            for at in range(0, len(probes), step):
                self._block(probes[at:at + step], kb, T)

    def _block(self, probes: np.ndarray, kb: np.ndarray, T: np.ndarray) -> None:
        longest = np.sqrt(np.einsum("ij,ij->i", T, T).max(initial=0.0))
        kind = np.float32 if self.norms[probes].max(initial=0.0) < 1e15 and longest < 1e15 else np.float64
        S = self.P[probes].astype(kind) @ T.T.astype(kind)
        if kind is np.float64 and not np.isfinite(S).all():
            raise ValueError(_NOT_FINITE)
        # the error of a product of rounded numbers, twice over, and that of rounded scores
        off = self.norms[probes] * (longest * (T.shape[1] + 4) * 2.0 ** -23) + 1e-9
        floor = self.least[probes] - off
        over = S >= floor[:, None]
        best = self.k + (self.excl is not None)     # the excluded row may be among the best
        if S.shape[1] > best and np.count_nonzero(over) > 4 * best * len(probes):
            cut = S.shape[1] - best
            over = S >= np.maximum(floor, np.partition(S, cut, axis=1)[:, cut].astype(np.float64) - 2 * off)[:, None]
        found = np.flatnonzero(over)
        for i in range(0, len(found), _EXACT_PAIRS):
            q, j = np.divmod(found[i:i + _EXACT_PAIRS], S.shape[1])
            q = probes[q]
            s = np.round(np.einsum("ij,ij->i", self.P[q], T[j]), SCORE_PLACES) + 0.0
            if not np.isfinite(s).all():
                raise ValueError(_NOT_FINITE)
            keep = s >= self.least[q]
            if self.last is not None:
                tie = np.flatnonzero((s == self.least[q]) & keep)
                keep[tie] = (kb[j[tie]] < self.last[q[tie]]).astype(bool)
            if self.excl is not None:
                keep &= self.excl[q] != kb[j]
            self.waiting.append((q[keep], kb[j[keep]], s[keep]))
            self.pairs += int(keep.sum())
            if self.pairs > 2 * self.k * len(self.P) + _BLOCK_CELLS // 16:
                self._rank()

    def _rank(self) -> None:
        # exact local top-k per probe: score desc, then corpus key asc
        q, key, s = (np.concatenate(x) for x in zip(*self.waiting))
        order = np.lexsort((pd.factorize(key, sort=True)[0] if key.dtype == object else key, -s, q))
        q = q[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        order, q, place = order[place < self.k], q[place < self.k], place[place < self.k]
        key, s = key[order], s[order]
        full = place == self.k - 1
        if self.last is None:
            self.last = np.empty(len(self.P), key.dtype)
        self.least[q[full]], self.last[q[full]] = s[full], key[full]
        self.waiting, self.pairs = [(q, key, s)], len(q)

    @property
    def cand(self) -> pd.DataFrame:
        """The best rows of every probe so far."""
        if not self.waiting:
            return pd.DataFrame({"q": np.zeros(0, np.int64), "key": [], "s": []})
        self._rank()
        return pd.DataFrame(dict(zip(("q", "key", "s"), self.waiting[0])))

    def batch(self, rows: pd.DataFrame, probe_keys: dict, key_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
        qi = rows["q"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(v[qi]) for v in probe_keys.values()]
                                          + [pa.array(rows["key"].to_numpy(), type=key_type),
                                             pa.array(rows["s"].to_numpy(), type=pa.float64())], names=names)


def cells(corpus: int, probes: int, width: int, result: int, cores: int, most: int, whole: bool = False) -> tuple[int, int]:
    """(groups of corpus rows, blocks of at most about ``most`` probes): every pair of them is a task's work.

    Each row is sent to every block, each probe to every group, and a probe hands on ``result`` bytes from
    each group. Both numbers follow from these sizes, so that there is work for all cores and what is sent is least.
    Where the ``whole`` of the scores is the result, a pair's scores are in memory together, so both sides
    of a pair are bounded; what is sent then is little beside the result.
    """
    if whole:
        return max(1, math.ceil(corpus / _RANKED_SIDE)), max(1, math.ceil(probes / _RANKED_SIDE))
    tasks = 2 * cores
    groups = math.ceil(math.sqrt(tasks * corpus * width / max(1, probes * (width + result))))
    groups = max(1, min(groups, tasks), math.ceil(corpus * width / _CELL_BYTES))
    return groups, max(math.ceil(probes / most), math.ceil(tasks / groups), 1)


def _matrix(tbl: pa.Table, col: str) -> np.ndarray:
    return _as_matrix(tbl.column(col), tbl.num_rows) if tbl.num_rows else np.zeros((0, 1))


def topk_dot(corpus: DataFrame, key: str, vec: str, probes: DataFrame, probe_keys: list[str],
             probe_vec: str, k: int | None, exclude_col: str | None = None,
             score_col: str = "score", rank_col: str = "rank",
             max_probe_bytes: int = DEFAULT_MAX_PROBE_BYTES, dim: int | None = None) -> DataFrame:
    """Per probe, the ``k`` corpus rows with the largest dot product.

    Ties are broken by corpus key ascending; ``k=None`` ranks the whole corpus.
    ``exclude_col`` (on probes) names a corpus key to skip for that probe.
    Returns probe keys + ``key`` + ``score`` (double) + ``rank`` (bigint, 1-based).
    A vector that is not finite raises an error.
    """
    spark = corpus.sparkSession
    cols = probe_keys + [probe_vec] + ([exclude_col] if exclude_col else [])
    key_type = corpus.schema[key].dataType
    key_arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}.get(key_type, pa.int64())
    names = [*probe_keys, key, score_col]
    out_schema = T.StructType([probes.schema[c] for c in probe_keys]
                              + [T.StructField(key, key_type), T.StructField(score_col, T.DoubleType())])
    # one bounded fetch both checks and takes a small probe side
    rows = max(1, max_probe_bytes // (8 * (dim or 64)))
    probes = materialize(probes.select(*cols))      # read several times
    small = probes.limit(rows + 1).toArrow()

    def held(tbl: pa.Table) -> tuple:
        excl = tbl.column(exclude_col).to_numpy(zero_copy_only=False) if exclude_col else None
        return _matrix(tbl, probe_vec), excl, {c: tbl.column(c).to_numpy(zero_copy_only=False) for c in probe_keys}

    def run(side: tuple, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        P, excl, keys = side
        if not P.shape[0]:
            return
        top = _TopK(P, excl, k)
        for kb, Tm in blocks:
            for part in top.add(kb, Tm):
                yield top.batch(part, keys, key_arrow, names)
        if k is not None and top.pairs:
            yield top.batch(top.cand, keys, key_arrow, names)

    if small.num_rows <= rows:
        bc = spark.sparkContext.broadcast(held(small))

        def kernel(batches):
            yield from run(bc.value, ((rb.column(0).to_numpy(zero_copy_only=False), _as_matrix(rb.column(1), rb.num_rows))
                                      for rb in batches if rb.num_rows))

        scored = corpus.select(key, vec).mapInArrow(kernel, out_schema)
    else:
        groups, blocks = cells(corpus.count(), probes.count(), 8 * (dim or 64), 24 * (k or 1), spark.sparkContext.defaultParallelism, rows, k is None)
        left = (corpus.select(key, vec).withColumn("__g", F.pmod(F.xxhash64(key), F.lit(groups)))
                      .withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))))
        right = (probes.select(*cols).withColumn("__b", F.pmod(F.xxhash64(*probe_keys), F.lit(blocks)))
                       .withColumn("__g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))))

        def cell(a: pa.Table, b: pa.Table) -> pa.Table:
            pair = [(a.column(key).to_numpy(zero_copy_only=False), _matrix(a, vec))] if a.num_rows else []
            found = list(run(held(b), iter(pair)))
            empty = pa.schema([*(b.schema.field(c) for c in probe_keys), pa.field(key, key_arrow), pa.field(score_col, pa.float64())])
            return pa.Table.from_batches(found) if found else empty.empty_table()

        scored = left.groupBy("__g", "__b").cogroup(right.groupBy("__g", "__b")).applyInArrow(cell, out_schema)
    if k is None:
        # the order of a whole corpus is not one task's work: rank all rows, then count from each probe's first
        total = with_global_rank(scored, [*[F.col(c).asc() for c in probe_keys], F.col(score_col).desc(), F.col(key).asc()], "__r")
        first = total.groupBy(*probe_keys).agg(F.min("__r").alias("__r0"))
        return total.join(first, probe_keys).withColumn(rank_col, F.col("__r") - F.col("__r0") + 1).drop("__r", "__r0")
    w = Window.partitionBy(*probe_keys).orderBy(F.col(score_col).desc(), F.col(key).asc())
    return scored.withColumn(rank_col, F.row_number().over(w).cast("bigint")).where(F.col(rank_col) <= k)


def rank_tables(tables: DataFrame, query_vectors: DataFrame, k: int | None = None,
                query_keys: list[str] = ("query_id",), table_key: str = "table_id",
                table_vec: str = "vec", query_vec: str = "vec") -> DataFrame:
    """Score every table against each query vector, keep top ``k``.

    Table vectors are L2-normalised on load (S4/V1); query vectors are used
    as given (the weighted query vector is already unit length, V8).
    """
    unit = with_l2_normalized(tables.select(table_key, table_vec), table_vec)
    return topk_dot(unit, table_key, table_vec, query_vectors, list(query_keys), query_vec, k)


def nearest_terms(word_vectors: DataFrame, queries: DataFrame, topn: int = 300) -> DataFrame:
    """``most_similar(query, topn)`` - cosine over unit vectors, self excluded.

    ``queries`` has (query_id, query); the query must be in the vocabulary.
    Returns (query_id, query, nb_rank, term, raw_score).
    """
    unit = with_l2_normalized(word_vectors.select("rank", "term", "vec"), "vec")
    # scaled after the join, so that only the queries' vectors are
    known = queries.join(word_vectors.select(F.col("term").alias("query"), F.col("rank").alias("q_rank"), "vec"), "query")
    probes = with_l2_normalized(known.select("query_id", "q_rank", "vec"), "vec")
    hits = topk_dot(unit.select("rank", "vec"), "rank", "vec", probes, ["query_id"], "vec", topn,
                    exclude_col="q_rank", score_col="raw_score", rank_col="nb_rank")
    return (hits.join(unit.select("rank", "term"), "rank")
                .join(queries, "query_id")
                .select("query_id", "query", "nb_rank", "term", "raw_score"))


def label_unknown(ranked: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """``table_name`` of each ranked key; a key that the catalogue doesn't have gets a label."""
    known = catalogue.select(F.col(key), "table_name")
    return (ranked.join(known, key, "left")
                  .withColumn("table_name", F.coalesce("table_name", F.format_string(UNKNOWN_KEY, F.col(key).cast("string")))))
