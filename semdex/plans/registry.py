"""Registered queries: one per operator of the blueprint, named ``<id>_<slug>``.

Each query takes (spark, sf_dir) and returns a DataFrame over the whole test
tables. ``ORACLE`` holds the DuckDB statement that must return the same rows
(doubles rounded to 6 places on both sides, integer columns as bigint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex import oracle as O
from semdex.functions.text import with_normalized
from semdex.functions.vectors import with_l2_normalized
from semdex.operators.encode import MAX_TOKENS, encode_texts
from semdex.operators.rank import nearest_terms, rank_tables, topk_dot
from semdex.operators.term_index import build_index, nearest_terms_indexed
from semdex.plans.context import Inputs

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# --- T1 ---------------------------------------------------------------------

@register("t1_normalize_text", f"""
SELECT doc_id, {O.t1('text')} AS norm_text FROM documents
""")
def t1_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = Inputs(spark, sf).table("documents").select("doc_id", "text")
    return with_normalized(docs, "text", "norm_text").select("doc_id", "norm_text")


# --- S3: vocabulary + word vectors -----------------------------------------

@register("s3_word_vectors", f"""
WITH {O.VOCAB}
SELECT v.rank, v.term, v.cnt, round(list_sum(list_transform(w.vec, lambda x, i: x * i)), 5) AS vsum
FROM vocab v JOIN wv w ON w.rank = v.rank
""")
def s3_word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    ctx = Inputs(spark, sf)
    vsum = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0).cast("double"), lambda a, x: a + x)
    return ctx.word_vectors.join(ctx.vocab.select("rank", "cnt"), "rank").select(
        "rank", "term", "cnt", F.round(vsum, 5).alias("vsum"))


# --- R1/R2: ranking of all tables for each query vector ---------------------

def _query_vectors(ctx: Inputs, max_tokens: int | None = None) -> DataFrame:
    enc = encode_texts(ctx.queries, "query", ctx.word_vectors, ctx.dim, max_tokens=max_tokens)
    return with_l2_normalized(enc.select("query_id", "vec"), "vec")


def _rank_sql(tokens: int | None) -> str:
    return f"""
WITH {O.VOCAB}, {O.queries_cte()}, {O.encode_cte('qv', 'queries', 'query_id', 'query', tokens)},
scored AS (
  SELECT q.query_id, e.vec_id AS table_id,
         round(list_dot_product({O.unit('q.vec')}, {O.unit('e.embedding::DOUBLE[]')}), 10) AS score
  FROM qv q, embeddings e),
ranked AS (SELECT query_id, table_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) AS rank FROM scored)
SELECT query_id, rank, table_id, round(score, 6) AS score FROM ranked {{where}}
"""


_RANK_SQL = _rank_sql(MAX_TOKENS)


@register("r1_full_ranking", _rank_sql(None).format(where=""))
def r1_full_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Every table ranked for every query; the order is no single task's work."""
    ctx = Inputs(spark, sf)
    r = rank_tables(ctx.tables, _query_vectors(ctx), k=None)
    return r.select("query_id", "rank", "table_id", _r6("score"))


@register("r2_topk_ranking", _RANK_SQL.format(where="WHERE rank <= 20"))
def r2_topk_ranking(spark: SparkSession, sf: str) -> DataFrame:
    ctx = Inputs(spark, sf)
    r = rank_tables(ctx.tables, _query_vectors(ctx, MAX_TOKENS), k=20)
    return r.select("query_id", "rank", "table_id", _r6("score"))


# --- R3: nearest vocabulary terms ------------------------------------------

@register("r3_nearest_terms", f"""
WITH {O.VOCAB}, {O.queries_cte()},
u AS (SELECT rank, term, {O.unit('vec')} AS vec FROM wv),
hits AS (
  SELECT q.query_id, q.query, t.term, round(list_dot_product(s.vec, t.vec), 10) AS raw_score, t.rank AS t_rank
  FROM queries q JOIN u s ON s.term = q.query JOIN u t ON t.rank <> s.rank),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, t_rank) AS nb_rank FROM hits)
SELECT query_id, query, nb_rank, term, round(raw_score, 6) AS raw_score FROM ranked WHERE nb_rank <= 300
""")
def r3_nearest_terms(spark: SparkSession, sf: str) -> DataFrame:
    ctx = Inputs(spark, sf)
    nb = nearest_terms(ctx.word_vectors, ctx.queries, topn=300)
    return nb.select("query_id", "query", "nb_rank", "term", _r6("raw_score"))


@register("r3_indexed_terms")
def r3_indexed_terms(spark: SparkSession, sf: str) -> DataFrame:
    """R3 through random-projection buckets, as many as hold 95 % of the neighbours of a sample of queries."""
    ctx = Inputs(spark, sf)
    nb = nearest_terms_indexed(build_index(ctx.word_vectors), ctx.queries, topn=300)
    return nb.select("query_id", "query", "nb_rank", "term", _r6("raw_score"))


# --- catalogue: S2, T2-T7, L1-L4, V5, R5 -------------------------------------
from semdex.functions.text import expand_table_name, strip_column_prefixes  # noqa: E402
from semdex.functions.vectors import norm  # noqa: E402
from semdex.operators.keywords import split_empty_documents, table_documents  # noqa: E402
from semdex.operators.lookup import column_lookup, explode_columns, table_lookup, with_metadata  # noqa: E402
from semdex.sources.catalog import catalogue_key  # noqa: E402

_CAT = f"WITH {O.CATALOGUE}"


@register("s2_catalogue_key", _CAT + """
SELECT table_name, seq, schema, row_count, n_columns FROM cat
""")
def s2_catalogue_key(spark, sf):
    c = Inputs(spark, sf).catalogue
    return c.select("table_name", "seq", "schema", "row_count", F.size("columns").cast("bigint").alias("n_columns"))


@register("t2_expand_table_name", _CAT + f"""
SELECT seq, table_name, {O.expand_table_name('table_name')} AS expanded FROM cat_entries
""")
def t2_expand_table_name(spark, sf):
    e = Inputs(spark, sf).catalogue_entries
    return e.select("seq", "table_name", expand_table_name(F.col("table_name")).alias("expanded"))


@register("t3_strip_column_prefix", _CAT + f"""
SELECT seq, ord, name, {O.strip_column_prefixes('name')} AS stripped FROM cat_cols
""")
def t3_strip_column_prefix(spark, sf):
    e = Inputs(spark, sf).catalogue_entries
    cols = e.select("seq", F.posexplode("columns").alias("ord", "c"))
    return cols.select("seq", F.col("ord").cast("bigint").alias("ord"), F.col("c.name").alias("name"),
                       strip_column_prefixes(F.col("c.name")).alias("stripped"))


@register("t6_table_document", _CAT + ", " + O.table_docs_cte() + """
SELECT table_name, document FROM tdocs
""")
def t6_table_document(spark, sf):
    # a document is made of one entry alone, so duplicates are dropped after it and no columns are sent
    return catalogue_key(table_documents(Inputs(spark, sf).catalogue_names)).select("table_name", "document")


@register("t7_empty_document_skip", _CAT + ", " + O.table_docs_cte() + """
SELECT table_name FROM tdocs WHERE document = ''
""")
def t7_empty_document_skip(spark, sf):
    _, rejected = split_empty_documents(catalogue_key(table_documents(Inputs(spark, sf).catalogue_names)))
    return rejected.select("table_name")


@register("l1_table_lookup", _CAT + """,
names AS (SELECT table_name AS lookup_name FROM cat_entries UNION SELECT reverse(table_name) FROM cat_entries)
SELECT n.lookup_name, (c.table_name IS NOT NULL) AS found, c.seq, c.schema, c.row_count
FROM names n LEFT JOIN cat c ON c.table_name = n.lookup_name
""")
def l1_table_lookup(spark, sf):
    ctx = Inputs(spark, sf)
    e = ctx.catalogue_entries
    names = (e.select(F.col("table_name").alias("lookup_name"))
              .union(e.select(F.reverse("table_name").alias("lookup_name"))).distinct())
    res = table_lookup(names, ctx.catalogue.select("table_name", "seq", "schema", "row_count"), "lookup_name")
    return res.select("lookup_name", "found", "seq", "schema", "row_count")


@register("l2_column_lookup", _CAT + """,
pairs AS (SELECT table_name, name AS column_name FROM cat_columns
          UNION SELECT table_name, reverse(name) || '#' FROM cat_columns),
firsts AS (SELECT table_name, name AS column_name, min(ord) AS ord FROM cat_columns GROUP BY ALL)
SELECT p.table_name, p.column_name, (f.ord IS NOT NULL) AS found, f.ord, c.null_fraction, c.distinct_count
FROM pairs p LEFT JOIN firsts f USING (table_name, column_name)
LEFT JOIN cat_columns c ON c.table_name = f.table_name AND c.ord = f.ord
""")
def l2_column_lookup(spark, sf):
    cat = Inputs(spark, sf).catalogue
    cols = explode_columns(cat)
    pairs = (cols.select("table_name", F.col("name").alias("column_name"))
                 .union(cols.select("table_name", F.concat(F.reverse("name"), F.lit("#")).alias("column_name")))
                 .distinct())
    res = column_lookup(pairs, cat)
    return res.select("table_name", "column_name", "found", "ord", "null_fraction", "distinct_count")


@register("l3_column_explosion", _CAT + """
SELECT table_name, ord, name, null_fraction, distinct_count FROM cat_columns
""")
def l3_column_explosion(spark, sf):
    return explode_columns(Inputs(spark, sf).catalogue).select(
        "table_name", "ord", "name", "null_fraction", "distinct_count")


@register("v5_table_vectors", _CAT + ", " + O.table_docs_cte() + ", " + O.VOCAB + ", "
          + O.encode_cte("tv", "tdocs_kept", "table_name", "document", None) + """
SELECT table_name, round(sqrt(list_dot_product(vec, vec)), 6) AS vnorm, round(list_sum(vec), 6) AS vsum FROM tv
""")
def v5_table_vectors(spark, sf):
    v = Inputs(spark, sf).catalogue_vectors
    return v.select("table_name", F.round(norm("vec"), 6).alias("vnorm"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"))


@register("r5_topn_enrichment", _CAT + ", " + O.table_docs_cte() + ", " + O.VOCAB + ", " + O.queries_cte()
          + ", " + O.encode_cte("tv", "tdocs_kept", "table_name", "document", None)
          + ", " + O.encode_cte("qv", "queries", "query_id", "query", None) + f""",
scored AS (SELECT q.query_id, t.table_name,
                  round(list_dot_product({O.unit('q.vec')}, {O.unit('t.vec')}), 10) AS score FROM qv q, tv t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_name) AS rank FROM scored)
SELECT r.query_id, r.rank, r.table_name, round(r.score, 6) AS score, c.schema, c.row_count, c.n_columns
FROM ranked r JOIN cat c USING (table_name) WHERE r.rank <= 5
""")
def r5_topn_enrichment(spark, sf):
    ctx = Inputs(spark, sf)
    tv = ctx.catalogue_vectors.select("table_name", "vec")
    top = rank_tables(tv, _query_vectors(ctx), k=5, table_key="table_name")
    meta = ctx.catalogue.select("table_name", "schema", "row_count",
                                F.size("columns").cast("bigint").alias("n_columns"), "columns")
    kept = with_metadata(top, meta)
    return (kept.join(meta.drop("columns"), "table_name")
                .select("query_id", "rank", "table_name", _r6("score"), "schema", "row_count", "n_columns"))


# --- expansion: L5-L9, T10, T11, E1, E2, E6 ---------------------------------------
from semdex.functions.lexical import has_digit, levenshtein_join  # noqa: E402
from semdex.functions.text import py_lower_strip  # noqa: E402
from semdex.operators.expand import (contains_query, contextual_similarity, expand_queries,  # noqa: E402
                                     filter_candidates, hybrid_scores, translate)

_EXP = f"WITH {O.VOCAB}, {O.queries_cte()}, " + O.r3_pairs_cte()


def _pairs(ctx: Inputs) -> DataFrame:
    nb = materialize(nearest_terms(ctx.word_vectors, ctx.queries, topn=300))     # read several times
    return nb.withColumn("clean", py_lower_strip("term"))


@register("l6_l7_lexical_flags", _EXP + """
SELECT query_id, nb_rank, term, (term = query) AS is_self,
  contains(replace(term, '-', ''), replace(query, '-', '')) AS contains_query,
  regexp_matches(term, '[0-9]') AS has_digit
FROM pairs
""")
def l6_l7_lexical_flags(spark, sf):
    p = _pairs(Inputs(spark, sf))
    return p.select("query_id", "nb_rank", "term", (F.col("clean") == F.col("query")).alias("is_self"),
                    contains_query().alias("contains_query"), has_digit(F.col("clean")).alias("has_digit"))


@register("l5_l9_filter_candidates")
def l5_l9_filter_candidates(spark, sf):
    """Strict and relaxed candidates of every known query."""
    ctx = Inputs(spark, sf)
    nb = materialize(nearest_terms(ctx.word_vectors, ctx.queries, topn=300))
    return filter_candidates(nb, 10).select("query_id", "pass", "nb_rank", F.col("clean").alias("term"), _r6("raw_score"))


@register("e1_contextual_similarity", _EXP + ", " + O.CONTEXT + """
SELECT query_id, term, round(bert_raw, 6) AS bert_raw FROM ctx
""")
def e1_contextual_similarity(spark, sf):
    ctx = Inputs(spark, sf)
    p = _pairs(ctx).select("query_id", "query", "clean")
    c = contextual_similarity(p, ctx.word_vectors, ctx.dim)
    return c.select("query_id", F.col("clean").alias("term"), _r6("bert_raw"))


@register("e2_hybrid_score", _EXP + ", " + O.CONTEXT + """,
parts AS (
  SELECT p.query_id, p.term,
    (list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) + 1.0) / 2.0 AS w2v_cos,
    tanh(list_dot_product(a.vec, b.vec) / 1e4) AS cooc,
    (greatest(-1.0, least(1.0, coalesce(c.bert_raw, 0.0))) + 1.0) / 2.0 AS bert_ctx
  FROM pairs p JOIN wv a ON a.term = p.query JOIN wv b ON b.term = p.term
  LEFT JOIN ctx c ON c.query_id = p.query_id AND c.term = p.term)
SELECT query_id, term, round(w2v_cos, 6) AS w2v_cos, round(cooc, 6) AS cooc, round(bert_ctx, 6) AS bert_ctx,
       round(0.6 * bert_ctx + 0.3 * w2v_cos + 0.1 * cooc, 6) AS score
FROM parts
""")
def e2_hybrid_score(spark, sf):
    ctx = Inputs(spark, sf)
    p = _pairs(ctx).select("query_id", "query", "clean", "nb_rank")
    s = hybrid_scores(p, ctx.word_vectors, ctx.dim)
    return s.select("query_id", F.col("clean").alias("term"), _r6("w2v_cos"), _r6("cooc"), _r6("bert_ctx"),
                    _r6("score"))


@register("t11_translate", f"WITH {O.VOCAB}, {O.queries_cte()}, {O.LEXICON}" + f""",
fwd AS (SELECT src, min(dst) AS dst FROM lex WHERE src_lang = 'fr' AND dst_lang = 'en' GROUP BY src),
q AS (SELECT query_id, {O.py_lower_strip('query')} AS q0 FROM queries WHERE query <> '')
SELECT q.query_id, q.q0 AS query,
  CASE WHEN f.dst IS NOT NULL AND f.dst <> '' AND f.dst <> q.q0 THEN f.dst ELSE q.q0 END AS translated,
  (f.dst IS NOT NULL AND f.dst <> '' AND f.dst <> q.q0) AS was_translated
FROM q LEFT JOIN fwd f ON f.src = q.q0
""")
def t11_translate(spark, sf):
    ctx = Inputs(spark, sf)
    q = (ctx.queries.where(F.col("query") != "")
            .select("query_id", py_lower_strip("query").alias("query")))
    t = translate(q, "query", ctx.lexicon, "fr", "en", "translated")
    return t.select("query_id", "query", "translated", F.col("translated_translated").alias("was_translated"))


@register("e6_expand_query")
def e6_expand_query(spark, sf):
    ctx = Inputs(spark, sf)
    out = expand_queries(ctx.queries, ctx.word_vectors, ctx.dim, n=10, lexicon=ctx.lexicon)
    return out.select("query_id", "pos", "term", _r6("score"))


_LEV = "(1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE)"
_FILTERED = f"""
strict AS (
  SELECT * FROM pairs WHERE term <> query AND NOT contains(replace(term, '-', ''), replace(query, '-', ''))
    AND NOT regexp_matches(term, '[0-9]') AND {_LEV.format(a='query', b='term')} < 0.5),
found AS (SELECT query_id, count(*) AS c FROM strict GROUP BY ALL),
spare AS (
  SELECT p.*, coalesce(f.c, 0) AS c, row_number() OVER (PARTITION BY p.query_id ORDER BY p.nb_rank) AS i
  FROM pairs p LEFT JOIN found f USING (query_id)
  WHERE p.nb_rank <= 50 AND p.term <> p.query AND NOT contains(replace(p.term, '-', ''), replace(p.query, '-', ''))
    AND NOT EXISTS (SELECT 1 FROM strict s WHERE s.query_id = p.query_id AND s.term = p.term)),
chosen AS (
  SELECT query_id, query, 1 AS pass, nb_rank, term, raw_score FROM strict
  UNION ALL SELECT query_id, query, 2, nb_rank, term, raw_score FROM spare WHERE c < 10 AND i <= 30 - c)
"""


@register("l5_l9_levenshtein", _EXP + ", " + _FILTERED + """
SELECT query_id, pass, nb_rank, term, round(raw_score, 6) AS raw_score FROM chosen
""")
def l5_l9_levenshtein(spark, sf):
    """L5-L9 with the native similarity: strict and relaxed candidates of every known query."""
    ctx = Inputs(spark, sf)
    nb = materialize(nearest_terms(ctx.word_vectors, ctx.queries, topn=300))
    return filter_candidates(nb, 10, lexical="levenshtein").select(
        "query_id", "pass", "nb_rank", F.col("clean").alias("term"), _r6("raw_score"))


@register("e6_expand_levenshtein", _EXP + ", " + _FILTERED + ", " + O.CONTEXT + f""",
hybrid AS (
  SELECT h.query_id, h.pass, h.nb_rank, h.term,
    0.6 * (greatest(-1.0, least(1.0, coalesce(c.bert_raw, 0.0))) + 1.0) / 2.0
    + 0.3 * (list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) + 1.0) / 2.0
    + 0.1 * tanh(list_dot_product(a.vec, b.vec) / 1e4) AS score
  FROM chosen h JOIN wv a ON a.term = h.query JOIN wv b ON b.term = h.term
  LEFT JOIN ctx c ON c.query_id = h.query_id AND c.term = h.term),
walked AS (
  SELECT query_id, list_reduce(list_transform(terms, lambda t: [t]), lambda kept, x:
      CASE WHEN len(kept) >= 9 OR len(list_filter(kept, lambda s: {_LEV.format(a='s', b='x[1]')} > 0.6)) > 0 THEN kept
           ELSE list_concat(kept, x) END, []::VARCHAR[]) AS kept
  FROM (SELECT query_id, list(term ORDER BY round(score, 10) DESC, pass, nb_rank) AS terms FROM hybrid GROUP BY ALL)),
named AS (SELECT query_id, {O.py_lower_strip('query')} AS q0 FROM queries WHERE query <> '')
SELECT query_id, 0::BIGINT AS pos, q0 AS term, 1.0::DOUBLE AS score FROM named
UNION ALL
SELECT w.query_id, w.pos, w.term, round(h.score, 6) FROM (
  SELECT query_id, unnest(range(1, len(kept) + 1))::BIGINT AS pos, unnest(kept) AS term FROM walked) w JOIN hybrid h USING (query_id, term)
""")
def e6_expand_levenshtein(spark, sf):
    """E6 without Python: filter and walk by the Levenshtein similarity, no translation."""
    ctx = Inputs(spark, sf)
    out = expand_queries(ctx.queries, ctx.word_vectors, ctx.dim, n=10, lexical="levenshtein")
    return out.select("query_id", "pos", "term", _r6("score"))


@register("t10_levenshtein_join", f"WITH {O.VOCAB}" + """,
gone AS (SELECT term, term AS rest FROM vocab
         UNION SELECT term, substr(term, 1, i - 1) || substr(term, i + 1) FROM vocab, LATERAL (SELECT unnest(range(1, length(term) + 1)) AS i))
SELECT DISTINCT a.term AS term, b.term AS other, levenshtein(a.term, b.term)::BIGINT AS distance
FROM gone a JOIN gone b USING (rest) WHERE a.term < b.term AND levenshtein(a.term, b.term) <= 1
""")
def t10_levenshtein_join(spark, sf):
    """T10 as a similarity join: vocabulary terms one edit apart."""
    vocab = Inputs(spark, sf).vocab.select("term")
    pairs = levenshtein_join(vocab, vocab.select(F.col("term").alias("other")), "term", "other", 1)
    return pairs.where(F.col("term") < F.col("other")).select("term", "other", F.col("distance").cast("bigint").alias("distance"))


# --- weights: V8, V9, G1-G8, G12, G13 -----------------------------------------------------
from semdex.operators import weights as Wt  # noqa: E402
from semdex.session import materialize  # noqa: E402

_W = f"WITH {O.VOCAB}, {O.queries_cte()}, " + O.r3_pairs_cte(9) + ", " + O.weights_cte()


class WeightInputs:
    """Candidates = each query with a vector plus its 9 nearest terms; population
    = 20 arithmetic weight vectors and an all-zero one per query."""

    def __init__(self, spark, sf):
        ctx = Inputs(spark, sf)
        self.ctx = ctx
        q = ctx.queries
        head = (q.join(ctx.word_vectors.select(F.col("term").alias("query")), "query")
                 .select("query_id", F.lit(0).cast("bigint").alias("pos"), F.col("query").alias("term")))
        nb = nearest_terms(ctx.word_vectors, q, topn=9).select("query_id", F.col("nb_rank").alias("pos"), "term")
        cands = materialize(head.unionByName(nb))
        self.cands = materialize(encode_texts(cands, "term", ctx.word_vectors, ctx.dim))
        base = (self.cands.select("query_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("ind"))
                    .withColumn("ind", F.col("ind").cast("bigint")))
        self.pop = base.withColumn(
            "w", F.when(F.col("ind") == 20, F.lit(0.0))
                  .otherwise(((F.col("ind") * 7919 + F.col("pos") * 104729) % 1000) / 1000.0))
        qt = q.where(F.col("query") != "").select("query_id", py_lower_strip("query").alias("query_original"))
        self.qtext = materialize(encode_texts(qt, "query_original", ctx.word_vectors, ctx.dim, out="qvec",
                                              key=["query_id"]))
        self.tables_unit = with_l2_normalized(ctx.tables, "vec")
        self.dim = ctx.dim


@register("g1_normalize_weights", _W + """
SELECT query_id, ind, pos, round(wc, 6) AS wc, round(wnorm, 6) AS wnorm FROM pn
""")
def g1_normalize_weights(spark, sf):
    wi = WeightInputs(spark, sf)
    return Wt.clip_normalize(wi.pop).select("query_id", "ind", "pos", _r6("wc"), _r6("wnorm"))


@register("v8_weighted_query_vector", _W + """
SELECT query_id, ind, round(sqrt(list_dot_product(raw, raw)), 6) AS raw_norm, round(list_sum(vec), 6) AS vsum
FROM vq
""")
def v8_weighted_query_vector(spark, sf):
    wi = WeightInputs(spark, sf)
    pn = Wt.clip_normalize(wi.pop)
    raw = Wt.weighted_sum(pn, wi.cands, "wnorm", wi.dim, "raw")
    unit = with_l2_normalized(raw.withColumn("vec", F.col("raw")), "vec")
    return unit.select("query_id", "ind", F.round(norm("raw"), 6).alias("raw_norm"),
                       F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"))


@register("g2_g3_topk_alignment", _W + """
SELECT query_id, ind, round(sum_topk, 6) AS sum_topk, round(table_align, 6) AS table_align FROM g23
""")
def g2_g3_topk_alignment(spark, sf):
    wi = WeightInputs(spark, sf)
    vq = Wt.weighted_query_vectors(Wt.clip_normalize(wi.pop), wi.cands, wi.dim)
    m = Wt.topk_metrics(vq, wi.tables_unit, "table_id", 20, 20)
    return m.select("query_id", "ind", _r6("sum_topk"), _r6("table_align"))


@register("g4_redundancy_penalty", _W + """
SELECT query_id, ind, round(penalty, 6) AS penalty FROM g4
""")
def g4_redundancy_penalty(spark, sf):
    wi = WeightInputs(spark, sf)
    p = Wt.redundancy_penalty(Wt.clip_normalize(wi.pop), Wt.unit_candidates(wi.cands), wi.dim)
    return p.select("query_id", "ind", _r6("penalty"))


@register("g5_context_metric", _W + """
SELECT query_id, ind, round(context, 6) AS context FROM g5
""")
def g5_context_metric(spark, sf):
    wi = WeightInputs(spark, sf)
    c = Wt.context_metric(Wt.clip_normalize(wi.pop), Wt.unit_candidates(wi.cands), wi.qtext)
    return c.select("query_id", "ind", _r6("context"))


@register("g6_query_bonus", _W + """
SELECT query_id, ind, round(bonus, 6) AS bonus FROM g6
""")
def g6_query_bonus(spark, sf):
    wi = WeightInputs(spark, sf)
    b = Wt.query_bonus(Wt.clip_normalize(wi.pop), wi.cands, wi.qtext)
    return b.select("query_id", "ind", _r6("bonus"))


@register("g7_fitness", _W + """
SELECT query_id, ind, round(sum_topk, 6) AS sum_topk, round(table_align, 6) AS table_align,
       round(penalty, 6) AS penalty, round(context, 6) AS context, round(bonus, 6) AS bonus,
       round(fitness, 6) AS fitness FROM g7
""")
def g7_fitness(spark, sf):
    wi = WeightInputs(spark, sf)
    f = Wt.fitness(wi.pop, wi.cands, wi.qtext, wi.tables_unit, "table_id", wi.dim)
    return f.select("query_id", "ind", *[_r6(c) for c in
                                         ("sum_topk", "table_align", "penalty", "context", "bonus", "fitness")])


@register("g8_best_individual", _W + """
SELECT query_id, ind, round(fitness, 6) AS fitness FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fitness DESC, ind) AS r FROM g7) WHERE r = 1
""")
def g8_best_individual(spark, sf):
    wi = WeightInputs(spark, sf)
    f = Wt.fitness(wi.pop, wi.cands, wi.qtext, wi.tables_unit, "table_id", wi.dim)
    return Wt.best_individual(f).select("query_id", "ind", _r6("fitness"))


@register("v9_baseline_ranking", _W + """,
oh AS (SELECT query_id, pos, CASE WHEN pos = 0 THEN 1.0 ELSE 0.0 END AS w FROM cands),
oh_dims AS (SELECT query_id, i, sum(w * x) AS x FROM (
   SELECT o.query_id, o.w, unnest(v.vec) AS x, generate_subscripts(v.vec, 1) AS i
   FROM oh o JOIN cvec v USING (query_id, pos)) GROUP BY ALL),
oh_raw AS (SELECT query_id, list(x ORDER BY i) AS raw FROM oh_dims GROUP BY ALL),
oh_vec AS (SELECT query_id, """ + O.unit("raw") + """ AS vec FROM oh_raw),
oh_sc AS (SELECT v.query_id, t.vec_id AS table_id, round(list_dot_product(v.vec, t.vec), 10) AS score FROM oh_vec v, tu t),
oh_rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) AS rank FROM oh_sc)
SELECT query_id, rank, table_id, round(score, 6) AS score FROM oh_rk WHERE rank <= 15
""")
def v9_baseline_ranking(spark, sf):
    wi = WeightInputs(spark, sf)
    pn = Wt.clip_normalize(Wt.one_hot_population(wi.cands))
    vq = Wt.weighted_query_vectors(pn, wi.cands, wi.dim).select("query_id", "vec")
    r = topk_dot(wi.tables_unit, "table_id", "vec", vq, ["query_id"], "vec", 15)
    return r.select("query_id", "rank", "table_id", _r6("score"))


@register("g12_weight_report", _W + """,
best AS (SELECT query_id, ind FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fitness DESC, ind) AS r FROM g7) WHERE r = 1),
fw AS (SELECT p.query_id, p.pos, p.wc / (sum(p.wc) OVER (PARTITION BY p.query_id) + 1e-12) AS w
       FROM pc p JOIN best b USING (query_id, ind))
SELECT f.query_id, row_number() OVER (PARTITION BY f.query_id ORDER BY f.w DESC, f.pos) AS row, c.term,
       printf('%.2f%%', f.w * 100) AS weight
FROM fw f JOIN cands c USING (query_id, pos)
""")
def g12_weight_report(spark, sf):
    wi = WeightInputs(spark, sf)
    f = Wt.fitness(wi.pop, wi.cands, wi.qtext, wi.tables_unit, "table_id", wi.dim)
    best = Wt.best_individual(f)
    chosen = wi.pop.join(best.select("query_id", "ind"), ["query_id", "ind"])
    return Wt.weight_report(Wt.final_weights(chosen), wi.cands)


@register("g13_ranking_report", _RANK_SQL.replace(
    "SELECT query_id, rank, table_id, round(score, 6) AS score FROM ranked {where}",
    "SELECT query_id, rank, table_id, printf('%.4f', score) AS similarity FROM ranked WHERE rank <= 50"))
def g13_ranking_report(spark, sf):
    ctx = Inputs(spark, sf)
    r = rank_tables(ctx.tables, _query_vectors(ctx, MAX_TOKENS), k=50)
    return Wt.ranking_report(r, "table_id", 50)


# --- columns: C0-C10 ----------------------------------------------------------------------
from semdex.operators import columns as Cx  # noqa: E402
from semdex.plans.features import FeatureInputs, feature_pipeline  # noqa: E402

def _c_sql(tokens: int | None) -> str:
    return (_CAT.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + O.table_docs_cte() + ", " + O.VOCAB + ", " + O.queries_cte()
            + ", " + O.encode_cte("tv", "tdocs_kept", "table_name", "document", tokens)
            + ", " + O.encode_cte("qv", "queries", "query_id", "query", tokens) + ", " + O.features_cte(5, tokens) + ", ")


_C = _c_sql(None)


def _features(spark, sf, max_tokens: int | None = None) -> FeatureInputs:
    ctx = Inputs(spark, sf)
    vectors = ctx.catalogue_vectors if max_tokens is None else ctx.catalogue_vectors_cut
    return FeatureInputs(ctx.queries, ctx.catalogue, vectors, ctx.word_vectors, ctx.dim, top_n=5, max_tokens=max_tokens)


def _profile(spark, sf):
    ctx = Inputs(spark, sf)
    out = None
    for t in ("lineitem", "orders", "customer"):
        p = Cx.column_profile(ctx.table(t), t)
        out = p if out is None else out.unionByName(p)
    return out


@register("c0_column_profile", f"SELECT table_name, \"column\", round(null_fraction, 6) AS null_fraction, "
                               f"distinct_count FROM ({O.profile_sql()})")
def c0_column_profile(spark, sf):
    return _profile(spark, sf).select("table_name", "column", _r6("null_fraction"), "distinct_count")


@register("c1_column_quality", f"""
SELECT table_name, "column", round((1.0 - coalesce(null_fraction, 0.0)) * (1.0 - 1.0 / (CASE WHEN
  coalesce(distinct_count, 1) = 0 THEN 1 ELSE coalesce(distinct_count, 1) END)), 6) AS quality
FROM ({O.profile_sql()})
""")
def c1_column_quality(spark, sf):
    p = _profile(spark, sf)
    return p.select("table_name", "column",
                    F.round(Cx.quality(F.col("null_fraction"), F.col("distinct_count")), 6).alias("quality"))


def _rule_runs():
    """Single columns, prefixes (1000000 + last) and all but one column (2000000 + left out)."""
    every = F.sequence(F.lit(0), F.col("n") - 1)

    def kind(base: int, first, inside: bool):
        return F.transform(every, lambda i: F.struct((i + base).cast("bigint").alias("subset_id"), first(i).cast("int").alias("first"),
                                                     i.alias("last"), F.lit(inside).alias("inside")))

    return F.concat(kind(0, lambda i: i, True), kind(1000000, lambda i: F.lit(0), True), kind(2000000, lambda i: i, False))


def _run_scores(fi: FeatureInputs) -> DataFrame:
    return Cx.run_scores(fi.tc, materialize(Cx.column_runs(fi.tables, _rule_runs())))


@register("c5_subset_fitness", _C + O.SUBSETS + """
SELECT query_id, table_name, subset_id, k, round(semantic, 6) AS semantic, round(quality, 6) AS quality,
       round(size_term, 6) AS size_term, round(fitness, 6) AS fitness FROM fit
""")
def c5_subset_fitness(spark, sf):
    s = _run_scores(_features(spark, sf))
    return s.select("query_id", "table_name", "subset_id", F.col("k").cast("bigint").alias("k"), _r6("semantic"),
                    _r6("quality"), _r6("size_term"), _r6("fitness"))


@register("c6_best_subset", _C + O.SUBSETS + """
SELECT query_id, table_name, subset_id, round(fitness, 6) AS fitness, k AS n_selected FROM best
""")
def c6_best_subset(spark, sf):
    b = Cx.best_subsets(_run_scores(_features(spark, sf)))
    return b.select("query_id", "table_name", "subset_id", _r6("fitness"), F.col("k").cast("bigint").alias("n_selected"))


@register("c7_greedy_subset", _C + O.GREEDY + """
SELECT query_id, table_name, round(fitness, 6) AS fitness, len(cols)::BIGINT AS n_selected FROM bsel
""")
def c7_greedy_subset(spark, sf):
    g = Cx.select_columns(_features(spark, sf).tc)
    return g.select("query_id", "table_name", _r6("fitness"), F.size("selected").cast("bigint").alias("n_selected"))


@register("c7_floating_subset", _c_sql(MAX_TOKENS) + O.FLOATING + """
SELECT query_id, table_name, round(fitness, 6) AS fitness, len(cols)::BIGINT AS n_selected, array_to_string(cols, '|') AS selected_columns FROM fsel
""")
def c7_floating_subset(spark, sf):
    g = Cx.float_columns(_features(spark, sf, MAX_TOKENS).tc)
    return g.select("query_id", "table_name", _r6("fitness"), F.size("selected").cast("bigint").alias("n_selected"),
                    F.array_join("selected", "|").alias("selected_columns"))


@register("c8_selected_columns", _C + O.GREEDY + """
SELECT query_id, table_name, unnest(range(1, len(cols) + 1))::BIGINT AS pos, unnest(cols) AS column_name FROM bsel
""")
def c8_selected_columns(spark, sf):
    b = Cx.select_columns(_features(spark, sf).tc)
    e = b.select("query_id", "table_name", F.posexplode("selected").alias("p", "column_name"))
    return e.select("query_id", "table_name", (F.col("p") + 1).cast("bigint").alias("pos"), "column_name")


_REPORT_SQL = f"""
SELECT s.query_id, s.table_name, round(s.fitness, 6) AS feature_relevance_score, {{columns}},
  coalesce(c.schema, 'N/A') AS schema, c.row_count,
  array_to_string(coalesce(c.primary_key, ['{Cx.NO_PRIMARY_KEY}']), ', ') AS primary_key,
  '{Cx.JUSTIFICATION.format(score="' || printf('%.4f', s.fitness) || '", cols="' || array_to_string(list_slice(s.cols, 1, 3), ', ')",
                            more=" || CASE WHEN len(s.cols) > 3 THEN '...' ELSE '' END || '")}' AS justification
FROM bsel s LEFT JOIN cat c USING (table_name) WHERE len(s.cols) > 0
"""


@register("c9_report", _C + O.GREEDY + _REPORT_SQL.format(columns="len(s.cols)::BIGINT AS n_selected"))
def c9_report(spark, sf):
    ctx = Inputs(spark, sf)
    r = Cx.report(Cx.select_columns(_features(spark, sf).tc), ctx.catalogue_heads)
    return r.select("query_id", "table_name", _r6("feature_relevance_score"),
                    F.size("selected_columns").cast("bigint").alias("n_selected"), "schema", "row_count",
                    F.array_join("primary_key", ", ").alias("primary_key"), "justification")


@register("c10_feature_pipeline", _C + O.GREEDY + _REPORT_SQL.format(
    columns="array_to_string(s.cols, '|') AS selected_columns"))
def c10_feature_pipeline(spark, sf):
    ctx = Inputs(spark, sf)
    fi = FeatureInputs(ctx.queries, ctx.catalogue, ctx.catalogue_vectors, ctx.word_vectors, ctx.dim, top_n=5)
    r = feature_pipeline(fi, ctx.catalogue_heads)
    return r.select("query_id", "table_name", _r6("feature_relevance_score"),
                    F.array_join("selected_columns", "|").alias("selected_columns"), "schema", "row_count",
                    F.array_join("primary_key", ", ").alias("primary_key"), "justification")


# --- composite search: G9, G11 ---------------------------------------------------------------
from semdex.plans.search import learn_weights, search  # noqa: E402


@register("g9_learn_weights", _W + ", " + O.learned_cte() + """
SELECT query_id, unnest(range(len(w))) AS pos, round(unnest(list_transform(w, lambda a: a / (list_sum(w) + 1e-12))), 6) AS w FROM lbest
""")
def g9_learn_weights(spark, sf):
    wi = WeightInputs(spark, sf)
    w = learn_weights(wi.cands, wi.qtext, wi.tables_unit, "table_id", wi.dim)
    return w.select("query_id", "pos", _r6("w"))


@register("g11_search_pipeline")
def g11_search_pipeline(spark, sf):
    ctx = Inputs(spark, sf)
    ranking, _ = search(ctx.queries, ctx.word_vectors, ctx.dim, ctx.catalogue_vectors, "table_name",
                        lexicon=ctx.lexicon, top=50)
    return ranking.select("query_id", "rank", "table_name", _r6("score"))


@register("g11_baseline_search")
def g11_baseline_search(spark, sf):
    ctx = Inputs(spark, sf)
    ranking, _ = search(ctx.queries, ctx.word_vectors, ctx.dim, ctx.catalogue_vectors, "table_name",
                        lexicon=ctx.lexicon, top=15, learn=False)
    return ranking.select("query_id", "rank", "table_name", _r6("score"))


# --- L11: language routing -------------------------------------------------------------------
from semdex.operators.encode import route_language  # noqa: E402


@register("l11_language_routing", f"""
SELECT doc_id, CASE WHEN lang IN ('en', 'es') THEN 'en' ELSE 'pt' END AS model_id,
  md5(CASE WHEN lang IN ('en', 'es') THEN text ELSE {O.t1('text')} END) AS text_md5
FROM documents
""")
def l11_language_routing(spark, sf):
    """Documents in 'en' request English; 'es' rows request 'auto'; the rest 'pt'."""
    docs = Inputs(spark, sf).table("documents").select(
        "doc_id", "text", F.when(F.col("lang") == "en", "en").when(F.col("lang") == "es", "auto")
                           .otherwise("pt").alias("req"))
    r = route_language(docs, "text", "req")
    return r.select("doc_id", "model_id", F.md5("text_to_embed").alias("text_md5"))


# --- S1: catalogue JSON scan -------------------------------------------------------------------
import uuid  # noqa: E402

from semdex.session import tables_folder  # noqa: E402
from semdex.sources.catalog import read_catalog_json, write_catalog_json  # noqa: E402


def _folder(spark: SparkSession, name: str) -> str:
    return f"{tables_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("s1_catalogue_scan", _CAT + """
SELECT e.table_name, e.schema, e.row_count, e.n_columns, round(s.nulls, 6) AS nulls, s.distincts
FROM cat_entries e JOIN (SELECT seq, coalesce(sum(null_fraction), 0.0) AS nulls, sum(distinct_count)::BIGINT AS distincts
                         FROM cat_cols_stats GROUP BY seq) s USING (seq)
""")
def s1_catalogue_scan(spark, sf):
    """The derived catalogue written as JSON lines and scanned back with the explicit schema."""
    path = _folder(spark, "catalogue")
    write_catalog_json(Inputs(spark, sf).catalogue_entries, path)
    back = read_catalog_json(spark, path, multiline=False)
    zero = F.lit(0.0).cast("double")
    return back.select("table_name", "schema", "row_count", F.size("columns").cast("bigint").alias("n_columns"),
                       F.round(F.aggregate("columns", zero, lambda a, c: a + F.coalesce(c["stats"]["null_fraction"], zero)), 6).alias("nulls"),
                       F.aggregate("columns", F.lit(0).cast("bigint"), lambda a, c: a + c["stats"]["distinct_count"]).alias("distincts"))


# --- R4, S5, S6: labels, stored index and stored weights -----------------------------------------
from semdex.operators.rank import label_unknown  # noqa: E402
from semdex.plans.index import (index_tables, open_table_index, read_learned_weights,  # noqa: E402
                                read_table_vectors, write_learned_weights, write_table_index, write_table_vectors)


@register("r4_unknown_label", _CAT + """
SELECT e.vec_id AS table_id, coalesce(c.table_name, 'ID_' || e.vec_id || '_DESCONHECIDO') AS table_name
FROM embeddings e LEFT JOIN cat c ON c.seq = e.vec_id
""")
def r4_unknown_label(spark, sf):
    """Every table vector under its catalogue name. Unknown are the entries that the catalogue key
    drops (an earlier one of two of the same name) and vectors beyond the documents."""
    ctx = Inputs(spark, sf)
    known = ctx.catalogue.select(F.col("seq").alias("table_id"), "table_name")
    return label_unknown(ctx.tables.select("table_id"), known, "table_id").select("table_id", "table_name")


@register("s5_stored_index_search", ORACLE["r5_topn_enrichment"].split("SELECT r.query_id, r.rank")[0] + """
SELECT query_id, rank, table_name, round(score, 6) AS score FROM ranked WHERE rank <= 20
""")
def s5_stored_index_search(spark, sf):
    """Offline index -> store (S5) -> read back -> top 20 of every query."""
    ctx, path = Inputs(spark, sf), _folder(spark, "index")
    vectors, _ = index_tables(ctx.catalogue_names, ctx.word_vectors, ctx.dim)
    write_table_vectors(vectors, path)
    r = rank_tables(read_table_vectors(spark, path), _query_vectors(ctx), k=20, table_key="table_name")
    return r.select("query_id", "rank", "table_name", _r6("score"))


@register("s5_bucketed_index", _CAT + ", " + O.table_docs_cte() + ", " + O.VOCAB + ", "
          + O.encode_cte("tv", "tdocs_kept", "table_name", "document") + """
SELECT c.table_name, c.seq, c.schema, round(sqrt(list_dot_product(t.vec, t.vec)), 6) AS vnorm, round(list_sum(t.vec), 6) AS vsum
FROM cat c JOIN tv t USING (table_name)
""")
def s5_bucketed_index(spark, sf):
    """The index as a bucketed table (S5), joined to the whole catalogue by name."""
    ctx, path = Inputs(spark, sf), _folder(spark, "bucketed")
    name = "semdex_index_" + path.rsplit("/", 1)[-1].replace("-", "_")
    write_table_index(ctx.catalogue_vectors_cut, name, path)
    named = catalogue_key(ctx.catalogue_entries.select("table_name", "seq", "schema"))    # without the columns
    j = named.join(open_table_index(spark, name, path), "table_name")
    return j.select("table_name", "seq", "schema", F.round(norm("vec"), 6).alias("vnorm"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"))


# --- V5: embeddings kept between runs ---------------------------------------------------------
from semdex.operators.encode_store import encode_stored  # noqa: E402


@register("v5_stored_encoding", f"WITH {O.VOCAB}, {O.queries_cte()}, {O.encode_cte('qv', 'queries', 'query_id', 'query')}" + """
SELECT query_id, round(sqrt(list_dot_product(vec, vec)), 6) AS vnorm, round(list_sum(vec), 6) AS vsum FROM qv
""")
def v5_stored_encoding(spark, sf):
    """Two runs over one store: the first encodes the benchmark's texts, the second, over the whole
    query batch, only the others."""
    ctx, path = Inputs(spark, sf), _folder(spark, "embeddings")
    encode_stored(ctx.table("benchmark").select("text"), "text", path, ctx.word_vectors, ctx.dim)
    v = encode_stored(ctx.queries, "query", path, ctx.word_vectors, ctx.dim)
    return v.select("query_id", F.round(norm("vec"), 6).alias("vnorm"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"))


@register("s6_stored_weights", _W + """,
best AS (SELECT query_id, ind FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fitness DESC, ind) AS r FROM g7) WHERE r = 1)
SELECT p.query_id, p.pos, round(p.wc / (sum(p.wc) OVER (PARTITION BY p.query_id) + 1e-12), 6) AS w
FROM pc p JOIN best b USING (query_id, ind)
""")
def s6_stored_weights(spark, sf):
    """The best individual's weights, appended as one run (S6) and read back."""
    wi, path = WeightInputs(spark, sf), _folder(spark, "weights")
    best = Wt.best_individual(Wt.fitness(wi.pop, wi.cands, wi.qtext, wi.tables_unit, "table_id", wi.dim))
    chosen = wi.pop.join(best.select("query_id", "ind"), ["query_id", "ind"])
    write_learned_weights(Wt.final_weights(chosen), path)
    return read_learned_weights(spark, path).select("query_id", "pos", _r6("w"))
