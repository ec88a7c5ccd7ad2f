"""Operator 1: sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table
(offset and skip from a digest of its name). The shards take turns; in its turn
a shard claims the first slot of its order that is still free. The full table
has a fixed size, whatever the data, so it is broadcast and a row is placed by
one hash and one look-up. Shards own nearly equal numbers of slots, and when
one is added or removed few other slots change hands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.llm._common import table

TABLE_SIZE = 65537      # prime; at least 100 slots a shard keep the shares within about 1 %
N_SHARDS = 256


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index of the shard that owns it."""
    if not _is_prime(size):
        raise ValueError("the table size must be prime, else a shard's order misses slots")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    owner = np.full(size, -1, dtype=np.int32)
    at = [_number(s, "offset") % size for s in shards]
    skip = [1 + _number(s, "skip") % (size - 1) if size > 2 else 1 for s in shards]
    free = size
    while free:
        for i in range(min(len(shards), free)):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + skip[i]) % size
            owner[slot] = i
            at[i] = (slot + skip[i]) % size
            free -= 1
    return owner


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Every row of `df` with its slot and the name of its shard.

    Equal keys share a shard. A null key counts as a key of its own, an empty
    string as another. Repeated rows are all kept; an empty table stays empty.
    Existing columns named like the two outputs are replaced. No shuffle: the
    broadcast side has `size` rows, a constant.
    """
    spark = df.sparkSession
    owner = lookup_table(shards, size)
    lookup = spark.createDataFrame(pa.table({
        slot_col: pa.array(np.arange(size, dtype=np.int64)),
        shard_col: pa.array(np.array(shards, dtype=object)[owner], pa.string())}))
    slotted = df.drop(shard_col).withColumn(
        slot_col, F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(size)))
    return slotted.join(F.broadcast(lookup), slot_col, "left")


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, splits: int = 8,
                 size: int = TABLE_SIZE) -> None:
    """Write `df` to one folder per shard; `splits` tasks write each shard, so a
    key that holds a third of all rows does not end in one task."""
    placed = place(df, key, shards, size)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns]), F.lit(splits))
    (placed.repartition(len(shards) * splits, F.col("shard"), salt)
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, "doc_id", shard_names(N_SHARDS))
