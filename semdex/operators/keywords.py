"""Table documents (T2-T7): catalogue entry -> sorted keyword text.

Per entry (one row, no shuffle): table-name words (T2) plus the words of every
non-empty column name after prefix stripping (T3), as a set (T4), minus stop
words and words of two characters or fewer (T5), sorted so the text is
reproducible, joined and normalised (T6). Entries whose document is empty are
returned separately (T7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdex.functions.text import (expand_table_name, keep_keyword, split_ws,
                                   strip_column_prefixes, with_normalized)


def with_keywords(entries: DataFrame, out: str = "keywords") -> DataFrame:
    """``out`` = distinct kept keywords, sorted (code point order)."""
    named_cols = F.filter(F.col("columns"), lambda c: c["name"].isNotNull() & (c["name"] != ""))
    names = F.transform(named_cols, lambda c: strip_column_prefixes(c["name"]))
    # an entry's words are split once, not name by name
    words = split_ws(F.concat_ws(" ", expand_table_name(F.col("table_name")), names))
    return entries.withColumn(out, F.sort_array(F.filter(F.array_distinct(words), keep_keyword)))


def table_documents(entries: DataFrame) -> DataFrame:
    """(table_name, seq, document); empty name -> empty document."""
    kw = with_keywords(entries.select("table_name", "seq", "columns"))
    joined = kw.select("table_name", "seq",
                       F.when(F.col("table_name").isNull() | (F.col("table_name") == ""), F.lit(""))
                        .otherwise(F.array_join("keywords", " ")).alias("__raw"))
    return with_normalized(joined, "__raw", "document").select("table_name", "seq", "document")


def split_empty_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) - tables without keywords leave the index."""
    return docs.where(F.col("document") != ""), docs.where(F.col("document") == "")
