"""Operator 5: exact deduplication by content sort.

The normalised texts are range-partitioned between sampled splitters and sorted
inside each partition (Spark's external sort, which spills), so equal texts lie
next to each other; a window over the sorted rows compares each text in full
with its neighbour and keeps one row of every run. Range partitioning already
gathers the runs, so the window adds no further shuffle. The sort key begins with
the leading characters and a hash of the text, and splitters are sampled of these
alone: the driver never gets texts, and texts that begin alike still spread.

A text that very many rows share would land between two splitters, in one task.
A first pass therefore counts the texts by a 64-bit hash (map-side combined) and
takes the `partitions` most frequent hashes with `hot_rows` rows or more: by
counting, no other text can exceed its fair share of a partition. The rows of
those texts also get a salt in the sort key, which splits a run into sub-runs;
their partial results, one row a sub-run and text, are then combined. The salt is a
hash of the identifier and of the partition that the row was read in, so rows without
identifier, or that repeat one, spread too, and a repeated task gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semdex.llm._common import ascii_lower, materialize, partitions, table

HOT_ROWS = 256
LEAD = 16


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "smallest", carry: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; a null text counts as
    empty, and empty texts equal each other. `keep` says which identifier of a
    group stays ("smallest" or "largest"); a null identifier stays only if its
    group has no other. Of rows that repeat the identifier too, one is kept.
    With `carry`, the result also has the input row as struct `row`, so clashing
    column names do no harm. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = docs.sparkSession
    n = partitions(spark)
    text = docs.select(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("norm"),
                       F.col(f"`{id_col}`").alias("doc_id"),
                       *([F.struct("*").alias("row")] if carry else []))
    counts = text.groupBy(F.xxhash64("norm").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    hot = [r.h for r in counts.where(F.col("n") >= hot_rows).orderBy(F.desc("n"), "h").limit(n).collect()]
    salt = F.lit(-1).cast("long")
    if hot:
        salt = F.when(F.col("h").isin(hot), F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(n))).otherwise(salt)
    ranged = (text.withColumn("lead", F.substring("norm", 1, LEAD)).withColumn("h", F.xxhash64("norm"))
              .withColumn("salt", salt).repartitionByRange("lead", "h", "salt"))

    run = Window.partitionBy("lead", "h", "salt", "norm")
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    first = F.row_number().over(run.orderBy(order)) == 1
    best = F.min if keep == "smallest" else F.max
    runs = ranged.select(
        "doc_id", "salt", *(["row"] if carry else []), first.alias("first"),
        best("doc_id").over(run).alias("keep_id"), F.count(F.lit(1)).over(run).alias("group_size"),
        F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"))
    if hot:
        runs = materialize(runs)
        # at most one row for each hot hash: a broadcast of bounded size
        whole = (runs.where("salt >= 0").groupBy("text_sha256", "n_bytes")
                 .agg(best("keep_id").alias("all_keep"), F.count(F.lit(1)).alias("all_size"),
                      F.collect_set(F.when(F.col("first"), F.struct("keep_id", "salt"))).alias("subruns"))
                 # a text has at most `partitions` sub-runs; of those that hold the identifier that stays, one keeps its row
                 .withColumn("all_salt", F.array_min(F.transform(F.filter("subruns", lambda r: r["keep_id"].eqNullSafe(F.col("all_keep"))),
                                                                 lambda r: r["salt"]))).drop("subruns"))
        runs = (runs.join(F.broadcast(whole), ["text_sha256", "n_bytes"], "left")
                .withColumn("keep_id", F.when(F.col("all_size").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")))
                .withColumn("group_size", F.coalesce("all_size", "group_size"))
                .withColumn("first", F.col("first") & (F.col("all_salt").isNull() | (F.col("all_salt") == F.col("salt")))))
    kept = F.col("first") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return runs.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256",
                       *(["row"] if carry else []))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort(docs, keep="largest")


OP5_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that stay, with the columns of documents."""
    return content_sort(docs, keep="largest", carry=True).where("kept").select("row.*")
