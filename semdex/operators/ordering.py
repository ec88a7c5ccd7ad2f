"""Total orders over a whole DataFrame without a single-partition window.

``row_number() over (order by ...)`` with no ``partition by`` moves every row
into one task. ``with_global_rank`` instead range-partitions on the sort key,
numbers rows inside each (ordered) partition, and adds the row count of the
partitions before it. The numbered rows are written once and both the counts
and the ranks are taken from that table: range bounds come from samples, so two
evaluations need not agree. The per-partition counts are one row per partition,
so broadcasting them has a proven size bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semdex.session import materialize

_LOW33 = (1 << 33) - 1


def with_global_rank(df: DataFrame, order: list[Column], out: str = "rank",
                     num_partitions: int | None = None) -> DataFrame:
    """0-based dense position of each row in the total order ``order``.

    ``order`` must be a total order (break ties on a key), otherwise positions
    of tied rows are arbitrary.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = materialize(ranged.withColumn("__mid", F.monotonically_increasing_id())
                         .withColumn("__pid", F.shiftright(F.col("__mid"), 33))
                         .withColumn("__idx", F.col("__mid").bitwiseAND(F.lit(_LOW33))).drop("__mid"))
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = counts.select(
        "__pid",
        (F.sum("__cnt").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("__cnt")).alias("__off"))
    return (tagged.join(F.broadcast(offsets), "__pid")
                  .withColumn(out, (F.col("__off") + F.col("__idx")).cast("bigint"))
                  .drop("__pid", "__idx", "__off"))
