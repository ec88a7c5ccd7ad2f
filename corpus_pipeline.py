"""The corpus pipeline: five stages over `documents`, each an operator of `semdex.llm`.

Quality classifier (rejected documents go), exact deduplication, n-gram Jaccard
join (one document of each group of near duplicates stays), mixing to target
weights (documents are repeated or left out), packing. A stage takes (spark,
docs, sf_dir); every stage but the last returns the columns of documents. `run`
writes each stage's result as Parquet and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semdex.llm.exact_dedup import dedup_stage
from semdex.llm.mixing import mix_stage
from semdex.llm.near_join import near_stage
from semdex.llm.packing import pack_stage
from semdex.llm.quality import quality_stage
from semdex.session import materialize

STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", dedup_stage),
    ("near_join", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

# learned weights, pivotal rounding and differencing have no SQL form; the tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
