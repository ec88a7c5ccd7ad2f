"""Feature analysis (C10): best columns of the top-N tables of each query.

ranking (R5, top N per query) -> column explosion (L3) -> column encoding
(V7, distinct texts once) -> greedy selection per (query, table) (C7) -> report
(C8, C9).
The query vector is the encoding of the unexpanded query. Texts are encoded whole, or
their first ``max_tokens`` tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdex.functions.vectors import with_l2_normalized
from semdex.operators.columns import report, select_columns, table_arrays, table_columns
from semdex.operators.encode import encode_columns, encode_texts
from semdex.operators.lookup import explode_columns, with_metadata
from semdex.operators.rank import rank_tables
from semdex.session import materialize


class FeatureInputs:
    def __init__(self, queries: DataFrame, catalogue: DataFrame, table_vectors: DataFrame,
                 word_vectors: DataFrame, dim: int, top_n: int = 5, ranking: DataFrame | None = None,
                 max_tokens: int | None = None):
        qv = encode_texts(queries.select("query_id", "query"), "query", word_vectors, dim, out="qvec",
                          key=["query_id"], max_tokens=max_tokens)
        self.qvecs = materialize(qv.select("query_id", "qvec"))
        if ranking is None:
            probes = with_l2_normalized(self.qvecs.select("query_id", F.col("qvec").alias("vec")), "vec")
            ranking = rank_tables(table_vectors.select("table_name", "vec"), probes, k=top_n,
                                  table_key="table_name")
        top = with_metadata(ranking.where(F.col("rank") <= top_n), catalogue)
        self.top = materialize(top.select("query_id", "table_name", "rank", "score"))
        cols = explode_columns(catalogue.join(self.top.select("table_name").distinct(), "table_name", "left_semi"))
        cols = encode_columns(cols, word_vectors, dim, description_col="description", max_tokens=max_tokens)
        self.tables = materialize(table_arrays(cols))
        self.tc = table_columns(self.top.select("query_id", "table_name"), self.tables, self.qvecs)


def feature_pipeline(fi: FeatureInputs, catalogue: DataFrame) -> DataFrame:
    """Report records for every (query, top table) with selected columns."""
    return report(select_columns(fi.tc), catalogue)
