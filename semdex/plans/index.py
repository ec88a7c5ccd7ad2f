"""Offline indexing: catalogue entries -> table documents -> table vectors.

One lazy plan: T2..T6 (documents, per row) -> S2 (key; documents are sent, not columns) -> T7 (drop empty) ->
V5 (token join + pooled mean, shuffled by table name) -> S5 (parquet sink).
The documents are written once (``materialize``): the encoder and the final join
would otherwise each re-run the keyword rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.operators.encode import encode_texts
from semdex.operators.keywords import split_empty_documents, table_documents
from semdex.session import materialize, write_and_clean
from semdex.sources.catalog import catalogue_key


def index_tables(entries: DataFrame, word_vectors: DataFrame, dim: int,
                 max_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Return (table vectors (table_name, document, vec), rejected table names); documents are
    encoded whole, or their first ``max_tokens`` tokens."""
    docs = materialize(catalogue_key(table_documents(entries)))
    kept, rejected = split_empty_documents(docs)
    vecs = encode_texts(kept, "document", word_vectors, dim, key=["table_name"], max_tokens=max_tokens)
    return vecs, rejected.select("table_name")


def write_table_vectors(vectors: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store unit-normalisable vectors keyed by name (hash-clustered).

    ``buckets`` hash-partitions the files by table name so later lookups and
    joins on the name read one bucket.
    """
    out = vectors.select("table_name", "vec")
    if buckets:
        out = out.repartition(buckets, "table_name")
    write_and_clean(out, path, "overwrite")


def write_table_index(vectors: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """S5 as the table ``name``, its files under ``path`` in ``buckets`` buckets by table name, one
    file each: a look-up by name reads one bucket, and a join on the name with a table of as many
    buckets needs no exchange of the index."""
    (vectors.select("table_name", "vec").repartition(buckets, "table_name").write.mode("overwrite").format("parquet")
            .bucketBy(buckets, "table_name").sortBy("table_name").option("path", path).saveAsTable(name))


def open_table_index(spark: SparkSession, name: str, path: str, buckets: int = 64) -> DataFrame:
    """The index that ``write_table_index`` stored, also in a session whose catalog doesn't know it yet."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (table_name STRING, vec ARRAY<DOUBLE>) USING parquet "
              f"CLUSTERED BY (table_name) SORTED BY (table_name) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_learned_weights(weights: DataFrame, path: str) -> None:
    """Append one run of learned weights, stamped with the run time."""
    (weights.withColumn("run_ts", F.unix_timestamp(F.current_timestamp()))
            .write.mode("append").partitionBy("run_ts").parquet(path))


def read_table_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, vec) of an index that ``write_table_vectors`` stored."""
    return spark.read.schema("table_name string, vec array<double>").parquet(path)


def read_learned_weights(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, pos, w, run_ts) of all runs; the newest has the largest ``run_ts``."""
    return spark.read.parquet(path)


def read_word_vectors(spark: SparkSession, path: str, cut: int | None = None) -> DataFrame:
    """S3: (rank, term, vec) from a stored table of word vectors, by frequency rank, cut at ``cut``."""
    vectors = spark.read.parquet(path)
    return (vectors if cut is None else vectors.where(F.col("rank") < cut)).select("rank", "term", "vec")
