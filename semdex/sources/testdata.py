"""Inputs derived from the driver's test tables.

The reference's own assets (catalogue JSON, word vectors) are not public, so
every input is *derived by Spark* from the given parquet tables and grows with
them:

* vocabulary  - distinct tokens of all ``documents`` texts, ranked by
  (count desc, token); every token has a word vector: row ``rank mod n`` of the
  ``n`` ``embeddings`` rows, its elements rotated by ``rank div n`` places;
* query batch - every ``benchmark`` text, every user turn of ``conversations``,
  the most frequent token of each of those texts, and the empty query;
* dictionary  - a frequency-aligned ``fr`` <-> ``en`` lexicon (T11 input);
* table vectors - ``embeddings`` rows, keyed by ``vec_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.functions.text import text_tokens
from semdex.operators.ordering import with_global_rank

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, token) for every token occurrence of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return docs.select("doc_id", "lang", F.explode(text_tokens("text")).alias("token"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, token, cnt): one pass over the texts feeds the vocabulary and the dictionary."""
    return doc_tokens(spark, sf_dir).groupBy("lang", "token").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary_from_counts(counts: DataFrame) -> DataFrame:
    """(rank bigint, term string, cnt bigint), rank 0 = most frequent."""
    per_token = counts.groupBy("token").agg(F.sum("cnt").cast("bigint").alias("cnt"))
    ranked = with_global_rank(per_token, [F.col("cnt").desc(), F.col("token").asc()], out="rank")
    return ranked.select("rank", F.col("token").alias("term"), "cnt")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary_from_counts(token_counts(spark, sf_dir))


def word_vectors(spark: SparkSession, sf_dir: str, vocab: DataFrame | None = None,
                 cut: int | None = None) -> DataFrame:
    """S3: (rank, term, vec) with the optional vocabulary cut ``rank < cut``."""
    vocab = vocab if vocab is not None else vocabulary(spark, sf_dir)
    if cut is not None:
        vocab = vocab.where(F.col("rank") < cut)
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("__at"), "embedding")
    n = max(1, emb.count())  # from the file footers
    turn = F.pmod(F.floor(F.col("rank") / n), F.size("embedding")).cast("int")
    turned = F.concat(F.slice("embedding", turn + 1, F.size("embedding")), F.slice("embedding", F.lit(1), turn))
    return (vocab.withColumn("__at", F.pmod("rank", F.lit(n))).join(emb, "__at")
                 .select("rank", "term", turned.alias("vec")))


# query ids of user turns and of keywords start here; benchmark items keep their own
TURN_IDS, KEYWORD_IDS = 10 ** 9, 2 * 10 ** 12


def query_batch(spark: SparkSession, sf_dir: str, vocab: DataFrame | None = None) -> DataFrame:
    """(query_id bigint, query string): whole texts, their most frequent tokens, ''."""
    vocab = vocab if vocab is not None else vocabulary(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        (F.lit(TURN_IDS) + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    texts = items.unionByName(turns)
    counts = (texts.select("query_id", F.explode(text_tokens("query")).alias("token"))
                   .groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("c")))
    keyword = (counts.groupBy("query_id").agg(F.min(F.struct(-F.col("c"), "token")).alias("k"))
                     .select(F.col("k.token").alias("term")).distinct())
    words = vocab.join(keyword, "term").select((F.lit(KEYWORD_IDS) + F.col("rank")).alias("query_id"),
                                               F.col("term").alias("query"))
    empty = spark.range(1).select(F.lit(-1).cast("bigint").alias("query_id"), F.lit("").alias("query"))
    return texts.unionByName(words).unionByName(empty)


def lang_lexicon(spark: SparkSession, sf_dir: str, src_lang: str = "fr", dst_lang: str = "en",
                 counts: DataFrame | None = None) -> DataFrame:
    """T11 input: (src_lang, dst_lang, src, dst) pairs aligned by frequency rank.

    Term at rank r among ``src_lang`` documents <-> term at rank r among
    ``dst_lang`` documents, both directions.
    """
    counts = counts if counts is not None else token_counts(spark, sf_dir)
    counts = counts.where(F.col("lang").isin(src_lang, dst_lang))
    ranked = with_global_rank(counts, [F.col("lang").asc(), F.col("cnt").desc(), F.col("token").asc()],
                              out="g")
    first = ranked.groupBy("lang").agg(F.min("g").alias("g0"))
    per_lang = ranked.join(F.broadcast(first), "lang").select(
        "lang", "token", (F.col("g") - F.col("g0")).alias("r"))
    s = per_lang.where(F.col("lang") == src_lang).select("r", F.col("token").alias("a"))
    d = per_lang.where(F.col("lang") == dst_lang).select("r", F.col("token").alias("b"))
    pairs = s.join(d, "r")
    fwd = pairs.select(F.lit(src_lang).alias("src_lang"), F.lit(dst_lang).alias("dst_lang"),
                       F.col("a").alias("src"), F.col("b").alias("dst"))
    back = pairs.select(F.lit(dst_lang).alias("src_lang"), F.lit(src_lang).alias("dst_lang"),
                        F.col("b").alias("src"), F.col("a").alias("dst"))
    return fwd.unionByName(back)


def table_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw table vectors (table_id, vec) from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("table_id"),
                                                     F.col("embedding").alias("vec"))


def vector_dim(vectors: DataFrame, col: str = "vec") -> int:
    """Dimension of a vector store (reads one row)."""
    row = vectors.select(F.size(col).alias("d")).limit(1).collect()
    if not row:
        raise ValueError("empty vector table")
    return int(row[0]["d"])
