"""Structured Streaming front end for the search.

The reference answers one interactive query at a time. Here query files
(``query_id``, ``query``) arriving in a folder form a stream; every
micro-batch is searched as one batch job (``foreachBatch``) against the
static word vectors and table index, and its rankings are written to
``<output>/epoch=<id>``. Writing by epoch with overwrite makes a replayed
micro-batch (after a failure) replace its own output: exactly-once results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semdex.plans.search import search

QUERY_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()),
                             T.StructField("query", T.StringType())])


def start_query_stream(spark: SparkSession, source_dir: str, output_dir: str, checkpoint_dir: str,
                       word_vectors: DataFrame, dim: int, tables: DataFrame, key: str,
                       lexicon: DataFrame | None = None, fmt: str = "parquet", learn: bool = False,
                       top: int = 50, available_now: bool = True, **search_args):
    """Start the stream; returns the ``StreamingQuery``."""
    stream = spark.readStream.schema(QUERY_SCHEMA).format(fmt).load(source_dir)

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        ranking, weights = search(batch, word_vectors, dim, tables, key, lexicon=lexicon, learn=learn,
                                  top=top, **search_args)
        (ranking.withColumn("epoch", F.lit(epoch_id))
                .write.mode("overwrite").parquet(f"{output_dir.rstrip('/')}/epoch={epoch_id}"))

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
