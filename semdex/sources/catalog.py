"""Catalogue sources.

A catalogue entry describes one database table: name, schema, row count,
primary key and an ordered list of columns with quality statistics
(``null_fraction`` in 0..1, ``distinct_count``). Entries are keyed by
``table_name`` everywhere (never by position); ``seq`` is the entry's order in
its source and decides which duplicate wins (the last one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the files name the share of nulls null_percentage (a fraction in 0..1, fixed value)
STATS = T.StructType([T.StructField("null_percentage", T.DoubleType()),
                      T.StructField("distinct_count", T.LongType())])
COLUMN = T.StructType([T.StructField("name", T.StringType()),
                       T.StructField("type", T.StringType()),
                       T.StructField("description", T.StringType()),
                       T.StructField("stats", STATS)])
CATALOG = T.StructType([T.StructField("table_name", T.StringType()),
                        T.StructField("schema", T.StringType()),
                        T.StructField("row_count", T.LongType()),
                        T.StructField("primary_key", T.ArrayType(T.StringType())),
                        T.StructField("columns", T.ArrayType(COLUMN))])


def read_catalog_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Read catalogue entries with an explicit schema.

    A single JSON array file is not splittable (``multiLine``); large
    catalogues should be stored as JSON lines or Parquet (``multiline=False``).
    ``seq`` is the entry's position as (file path, position in the file): Spark
    packs files into partitions by size, so a bare row id would not follow
    file order when "the last duplicate wins" across several files.
    """
    df = (spark.read.schema(CATALOG).option("multiLine", multiline).option("mode", "FAILFAST")
               .json(path))
    def renamed(c):
        stats = F.struct(c["stats"]["null_percentage"].alias("null_fraction"),
                         c["stats"]["distinct_count"].alias("distinct_count"))
        return F.struct(c["name"].alias("name"), c["type"].alias("type"), c["description"].alias("description"),
                        F.when(c["stats"].isNotNull(), stats).alias("stats"))

    df = df.withColumn("columns", F.transform("columns", renamed))
    return df.withColumn("seq", F.struct(F.input_file_name().alias("file"),
                                         F.monotonically_increasing_id().alias("pos")))


# Fixed rule for the test catalogue derived from ``documents``: table-name and
# column-name prefixes cycle through these lists.
DOC_TABLE_PREFIXES = ["tb_", "ta_", "tl_", "rl_", "dim_", ""]
DOC_COLUMN_PREFIXES = ["co_", "id_", "cd_", "dt_", "st_", "tp_", "ds_", "nr_", "co_id_", "id_co_", ""]


def write_catalog_json(entries: DataFrame, path: str) -> None:
    """Catalogue entries as JSON lines under the files' own field names."""
    def filed(c):
        return F.struct(c["name"].alias("name"), c["type"].alias("type"), c["description"].alias("description"),
                        F.struct(c["stats"]["null_fraction"].alias("null_percentage"),
                                 c["stats"]["distinct_count"].alias("distinct_count")).alias("stats"))

    entries.drop("seq").withColumn("columns", F.transform("columns", filed)).write.json(path)


def catalogue_from_documents(docs: DataFrame, names_only: bool = False) -> DataFrame:
    """Test catalogue: one entry per document, one column per line of text. With ``names_only``
    a column is its name alone, for readers of nothing else.

    * table_name = prefix(doc_id) + lang + '_' + md5(text)
      (exact copies of a text collide: duplicate names, last ``seq`` wins);
    * schema = source; row_count = n_chars (missing when doc_id % 7 = 0);
      primary_key = ['id_' + lang] (missing when doc_id % 5 = 0);
    * column i = prefix(i) + the line with runs of spaces as '_', type 'text',
      description (of every other column): the line itself;
      stats: distinct_count = distinct words of the line,
      null_fraction = 1 - distinct/words (missing for an empty line).
    """
    tprefix = F.element_at(F.array(*[F.lit(p) for p in DOC_TABLE_PREFIXES]),
                           (F.col("doc_id") % len(DOC_TABLE_PREFIXES) + 1).cast("int"))
    cprefixes = F.array(*[F.lit(p) for p in DOC_COLUMN_PREFIXES])

    def name(line, i):
        return F.concat(F.element_at(cprefixes, (i % len(DOC_COLUMN_PREFIXES) + 1).cast("int")),
                        F.regexp_replace(line, " +", "_")).alias("name")

    def column(counted, i):
        line, n, d = counted["line"], counted["n"], counted["d"]
        nf = F.when(n > 0, F.round(F.lit(1.0) - d / n, 6))
        return F.struct(name(line, i), F.lit("text").alias("type"),
                        F.when(i % 2 == 1, line).alias("description"),
                        F.struct(nf.cast("double").alias("null_fraction"),
                                 d.cast("bigint").alias("distinct_count")).alias("stats"))

    lines = F.split("text", "\n")
    # each step's value is bound once: an expression in a lambda is evaluated wherever it stands
    split = F.transform(lines, lambda x: F.struct(x.alias("line"), F.filter(F.split(x, " "), lambda w: w != "").alias("words")))
    counted = F.transform(split, lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("n"),
                                                    F.size(F.array_distinct(x["words"])).alias("d")))
    columns = F.transform(lines, lambda x, i: F.struct(name(x, i))) if names_only else F.transform(counted, column)

    return docs.select(
        F.col("doc_id").alias("seq"),
        F.concat(tprefix, F.col("lang"), F.lit("_"), F.md5("text")).alias("table_name"),
        F.col("source").alias("schema"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("row_count"),
        F.when(F.col("doc_id") % 5 != 0, F.array(F.concat(F.lit("id_"), F.col("lang")))).alias("primary_key"),
        columns.alias("columns"),
    )


def catalogue_key(entries: DataFrame) -> DataFrame:
    """Drop empty/null names; for a duplicated name the largest ``seq`` wins.

    ``max_by`` is an aggregate with partial aggregation: a name repeated
    millions of times is reduced map-side, never gathered in one task.
    """
    named = entries.where(F.col("table_name").isNotNull() & (F.col("table_name") != ""))
    others = [c for c in named.columns if c not in ("table_name", "seq")]
    agg = named.groupBy("table_name").agg(
        F.max_by(F.struct(*[F.col(c) for c in others]), F.col("seq")).alias("__e"),
        F.max("seq").alias("seq"))
    return agg.select("table_name", "seq", *[F.col(f"__e.{c}").alias(c) for c in others])


def catalogue_key_window(entries: DataFrame) -> DataFrame:
    """S2 written with a window (same result; kept for comparison in tests)."""
    w = Window.partitionBy("table_name").orderBy(F.col("seq").desc())
    named = entries.where(F.col("table_name").isNotNull() & (F.col("table_name") != ""))
    return named.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
