"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"     # what separates words
SPACES = " \t\n\x0b\x0c\r"

__all__ = ["ascii_lower", "delta_planes", "from_delta_planes", "join_groups", "materialize", "partitions", "table", "uniform", "word_count", "word_list"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def _trimmed(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def word_list(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text; none for null or blank text."""
    trimmed = _trimmed(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def word_count(text: Column) -> Column:
    trimmed = _trimmed(text)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_CLASS))).cast("long")


def uniform(*keys: Column) -> Column:
    """A double in [0, 1) that depends on the keys alone, so reruns agree."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, hot_rows: int = 256) -> DataFrame:
    """`rows` with the columns of `groups` (one row per key, `size` rows of `rows` each).

    Of the groups, the `partitions` largest with `hot_rows` rows or more go to
    every task, a broadcast of bounded size; by counting, no other key exceeds a
    partition's fair share, and those are joined by a shuffle. Both inputs are
    read twice, so pass written tables.
    """
    n = partitions(rows.sparkSession)
    hot = [r[0] for r in groups.where(F.col(size) >= hot_rows).orderBy(F.desc(size), key).limit(n).select(key).collect()]
    if not hot:
        return rows.join(groups, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return (rows.where(is_hot).join(F.broadcast(groups.where(is_hot)), key)
            .unionByName(rows.where(~is_hot).join(groups.where(~is_hot), key)))


def delta_planes(sorted_ints: np.ndarray, width: int) -> bytes:
    """Differences of sorted integers, byte by byte, so that the high bytes compress away."""
    d = np.diff(sorted_ints, prepend=np.uint64(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_delta_planes(data: bytes, width: int) -> np.ndarray:
    d = np.zeros((len(data) // width, 8), np.uint8)
    d[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return np.cumsum(d.view("<u8").ravel())
