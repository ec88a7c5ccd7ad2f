"""DuckDB SQL that states, independently of the Spark plans, what each
registered query must return. Used by ``__spark_entry__.oracle_sql`` and the
tests. Fragments are composed as CTEs over the pre-registered test views.
"""

from __future__ import annotations

from semdex.functions.text import COLUMN_PREFIXES, CONTEXT_TEMPLATES, STOP_WORDS, TABLE_PREFIXES
from semdex.plans.search import A_IND, A_POS, A_QUERY, PRIME, STEP
from semdex.sources.testdata import KEYWORD_IDS, TURN_IDS

ASCII_WS = r"[ \t\n\r\x0b\x0c\x1c-\x1f]+"


def t1(expr: str) -> str:
    """normalize_text: accents off, non-ASCII dropped, lower, whitespace collapsed."""
    return (f"trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce({expr}, '')), "
            f"'[^\\x00-\\x7f]', '', 'g')), '{ASCII_WS}', ' ', 'g'))")


def unit(expr: str) -> str:
    """V1 on a DOUBLE[] expression (zero vector stays zero)."""
    n = f"sqrt(list_dot_product({expr}, {expr}))"
    return f"list_transform({expr}, lambda x: x / (CASE WHEN {n} = 0 THEN 1.0 ELSE {n} END))"


DIM = "(SELECT len(embedding) FROM embeddings LIMIT 1)"
ZERO = f"list_transform(range({DIM}), lambda i: 0.0::DOUBLE)"

VOCAB = f"""
docs_norm AS (SELECT doc_id, lang, {t1('text')} AS norm FROM documents),
toks AS (SELECT doc_id, lang, unnest(regexp_split_to_array(norm, '[^a-z0-9]+')) AS token FROM docs_norm),
vocab AS (
  SELECT (row_number() OVER (ORDER BY cnt DESC, token) - 1)::BIGINT AS rank, token AS term, cnt
  FROM (SELECT token, count(*)::BIGINT AS cnt FROM toks WHERE token <> '' GROUP BY token)),
n_emb AS (SELECT count(*) AS n, any_value(len(embedding)) AS d FROM embeddings),
wv AS (SELECT v.rank, v.term, list_concat(list_slice(e.embedding, (v.rank // n) % d + 1, d),
                                          list_slice(e.embedding, 1, (v.rank // n) % d))::DOUBLE[] AS vec
       FROM vocab v, n_emb JOIN embeddings e ON e.vec_id = v.rank % n)
"""

def queries_cte() -> str:
    return f"""
qtexts AS (
  SELECT item_id AS query_id, text AS query FROM benchmark
  UNION ALL SELECT {TURN_IDS} + conv_id * 1000 + turn, text FROM conversations WHERE role = 'user'),
qwords AS (
  SELECT DISTINCT first(token ORDER BY c DESC, token) AS term FROM (
    SELECT query_id, token, count(*) AS c FROM (
      SELECT query_id, unnest(regexp_split_to_array({t1('query')}, '[^a-z0-9]+')) AS token FROM qtexts)
    WHERE token <> '' GROUP BY ALL) GROUP BY query_id),
queries AS (
  SELECT query_id::BIGINT AS query_id, query FROM qtexts
  UNION ALL SELECT {KEYWORD_IDS} + rank, term FROM vocab JOIN qwords USING (term)
  UNION ALL SELECT -1, '')
"""


def encode_cte(name: str, src: str, key: str, text: str, tokens: int | None = 512) -> str:
    """Static encoder over ``src`` (key, text): mean of word vectors of the first ``tokens`` tokens."""
    words = f"list_filter(regexp_split_to_array({t1('s.' + text)}, '[^a-z0-9]+'), lambda w: w <> '')"
    if tokens is not None:
        words = f"list_slice({words}, 1, {tokens})"
    return f"""
{name}_tok AS (SELECT s.{key} AS k, t.token FROM {src} s, unnest({words}) AS t(token)),
{name}_dims AS (SELECT k, i, avg(x) AS x FROM (
     SELECT e.k, unnest(wv.vec) AS x, generate_subscripts(wv.vec, 1) AS i
     FROM {name}_tok e JOIN wv ON wv.term = e.token) GROUP BY k, i),
{name}_agg AS (SELECT k, list(x ORDER BY i) AS vec FROM {name}_dims GROUP BY k),
{name} AS (SELECT s.{key} AS {key}, coalesce(a.vec, {ZERO}) AS vec FROM {src} s LEFT JOIN {name}_agg a ON a.k = s.{key})
"""


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


# --- catalogue derived from documents ----------------------------------------
PY_WS = (r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}-\x{2029}\x{202F}\x{205F}\x{3000}]")


def py_lower_strip(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def py_split(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{PY_WS}+'), lambda w: w <> '')"


def expand_table_name(expr: str) -> str:
    b = f"replace({py_lower_strip(expr)}, '_', ' ')"
    whens = " ".join(f"WHEN starts_with({b}, '{s} ') THEN '{w} ' || substr({b}, {len(s) + 2})" for s, w in TABLE_PREFIXES)
    return f"(CASE {whens} ELSE {b} END)"


def strip_column_prefixes(expr: str) -> str:
    b = f"replace({py_lower_strip(expr)}, '_', ' ')"
    return f"regexp_replace({b}, '^{''.join(f'({p} )?' for p in COLUMN_PREFIXES)}', '')"


CATALOGUE = """
cat_entries AS (
  SELECT doc_id AS seq,
    ['tb_','ta_','tl_','rl_','dim_',''][(doc_id % 6) + 1] || lang || '_' || md5(text) AS table_name,
    source AS schema,
    CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS row_count,
    CASE WHEN doc_id % 5 <> 0 THEN ['id_' || lang] END AS primary_key,
    text, len(string_split(text, chr(10)))::BIGINT AS n_columns
  FROM documents),
cat_lines AS (
  SELECT seq, table_name, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM cat_entries),
cat_cols AS (
  SELECT seq, table_name, (i - 1)::BIGINT AS ord,
    ['co_','id_','cd_','dt_','st_','tp_','ds_','nr_','co_id_','id_co_',''][((i - 1) % 11) + 1]
      || regexp_replace(line, ' +', '_', 'g') AS name,
    CASE WHEN (i - 1) % 2 = 1 THEN line END AS description,
    len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS n_words,
    len(list_distinct(list_filter(string_split(line, ' '), lambda w: w <> ''))) AS n_distinct
  FROM cat_lines),
cat_cols_stats AS (
  SELECT seq, table_name, ord, name, description, 'text' AS type,
    CASE WHEN n_words > 0 THEN round(1.0 - n_distinct / n_words, 6) END AS null_fraction,
    n_distinct::BIGINT AS distinct_count
  FROM cat_cols),
cat AS (
  SELECT table_name, seq, schema, row_count, primary_key, n_columns FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY seq DESC) AS r
    FROM cat_entries WHERE table_name IS NOT NULL AND table_name <> '') WHERE r = 1),
cat_columns AS (SELECT c.* FROM cat_cols_stats c JOIN cat USING (table_name, seq))
"""


def table_docs_cte() -> str:
    return f"""
kw_all AS (
  SELECT table_name, unnest({py_split(expand_table_name('table_name'))}) AS w FROM cat
  UNION
  SELECT table_name, unnest({py_split(strip_column_prefixes('name'))}) AS w FROM cat_columns
  WHERE name IS NOT NULL AND name <> ''),
kw AS (SELECT table_name, list_sort(list(w)) AS kws FROM kw_all
       WHERE NOT list_contains({STOP_SQL}, w) AND length(w) > 2 GROUP BY table_name),
tdocs AS (SELECT c.table_name, {t1("coalesce(array_to_string(k.kws, ' '), '')")} AS document
          FROM cat c LEFT JOIN kw k USING (table_name)),
tdocs_kept AS (SELECT * FROM tdocs WHERE document <> '')
"""


# --- expansion ------------------------------------------------------------------
def r3_pairs_cte(topn: int = 300) -> str:
    return f"""
u AS (SELECT rank, term, {unit('vec')} AS vec FROM wv),
nb_hits AS (
  SELECT q.query_id, q.query, t.term, round(list_dot_product(s.vec, t.vec), 10) AS raw_score, t.rank AS t_rank
  FROM queries q JOIN u s ON s.term = q.query JOIN u t ON t.rank <> s.rank),
nb_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, t_rank) AS nb_rank FROM nb_hits),
pairs AS (SELECT query_id, query, nb_rank, term, raw_score FROM nb_ranked WHERE nb_rank <= {topn})
"""


def templates_sql(w: str) -> str:
    return "[" + ", ".join("'" + t.replace("{}", f"' || {w} || '", 1).replace("{}", "") + "'" for t in CONTEXT_TEMPLATES) + "]"


CONTEXT = f"""
tq AS (SELECT query_id, term, unnest({templates_sql('query')}) AS qt,
              generate_subscripts({templates_sql('query')}, 1) AS j FROM pairs),
tt AS (SELECT query_id, term, unnest({templates_sql('term')}) AS tt,
              generate_subscripts({templates_sql('term')}, 1) AS j FROM pairs),
ctexts AS (SELECT DISTINCT qt AS text FROM tq UNION SELECT DISTINCT tt FROM tt),
{encode_cte('cenc', 'ctexts', 'text', 'text', None)},
ctx AS (
  SELECT tq.query_id, tq.term,
    avg(CASE WHEN sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)) = 0 THEN 0.0
             ELSE list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))) END) AS bert_raw
  FROM tq JOIN tt USING (query_id, term, j) JOIN cenc a ON a.text = tq.qt JOIN cenc b ON b.text = tt.tt
  GROUP BY tq.query_id, tq.term)
"""

LEXICON = f"""
lang_counts AS (SELECT lang, token, count(*) AS cnt FROM toks WHERE token <> '' AND lang IN ('fr', 'en') GROUP BY ALL),
lang_ranked AS (SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, token) - 1 AS r FROM lang_counts),
lex AS (
  SELECT 'fr' AS src_lang, 'en' AS dst_lang, a.token AS src, b.token AS dst
  FROM lang_ranked a JOIN lang_ranked b ON a.r = b.r AND a.lang = 'fr' AND b.lang = 'en'
  UNION ALL
  SELECT 'en', 'fr', b.token, a.token
  FROM lang_ranked a JOIN lang_ranked b ON a.r = b.r AND a.lang = 'fr' AND b.lang = 'en')
"""


# --- weight scoring --------------------------------------------------------------------
def weights_cte() -> str:
    return f"""
cands AS (
  SELECT q.query_id, 0::BIGINT AS pos, q.query AS term FROM queries q JOIN wv ON wv.term = q.query
  UNION ALL SELECT query_id, nb_rank::BIGINT, term FROM pairs),
cterms AS (SELECT DISTINCT term FROM cands),
{encode_cte('tenc', 'cterms', 'term', 'term')},
cvec AS (SELECT c.query_id, c.pos, c.term, t.vec FROM cands c JOIN tenc t USING (term)),
pop AS (SELECT c.query_id, i.ind::BIGINT AS ind, c.pos,
          CASE WHEN i.ind = 20 THEN 0.0 ELSE ((i.ind * 7919 + c.pos * 104729) % 1000) / 1000.0 END AS w
        FROM cands c, range(21) i(ind)),
pc AS (SELECT *, least(1.0, greatest(0.0, w)) AS wc FROM pop),
pn AS (SELECT *, wc / CASE WHEN s = 0 THEN 1.0 ELSE s END AS wnorm FROM (
         SELECT *, sum(wc) OVER (PARTITION BY query_id, ind) AS s FROM pc)),
vq_dims AS (SELECT query_id, ind, i, sum(wnorm * x) AS x FROM (
    SELECT p.query_id, p.ind, p.wnorm, unnest(v.vec) AS x, generate_subscripts(v.vec, 1) AS i
    FROM pn p JOIN cvec v USING (query_id, pos)) GROUP BY ALL),
vq_raw AS (SELECT query_id, ind, list(x ORDER BY i) AS raw FROM vq_dims GROUP BY ALL),
vq AS (SELECT query_id, ind, raw, {unit('raw')} AS vec FROM vq_raw),
tu AS (SELECT vec_id, {unit('embedding::DOUBLE[]')} AS vec FROM embeddings),
sc AS (SELECT v.query_id, v.ind, t.vec_id, round(list_dot_product(v.vec, t.vec), 10) AS score,
              sqrt(list_dot_product(v.vec, v.vec)) AS qn, sqrt(list_dot_product(t.vec, t.vec)) AS tn
       FROM vq v, tu t),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, ind ORDER BY score DESC, vec_id) AS rank FROM sc),
g23 AS (SELECT query_id, ind, sum(score) AS sum_topk,
               avg(score / ((tn + 1e-12) * (qn + 1e-12))) AS table_align FROM rk WHERE rank <= 20 GROUP BY ALL),
cu AS (SELECT query_id, pos, {unit('vec')} AS vec FROM cvec),
g4p AS (SELECT a.query_id, a.ind, sum(a.wc * b.wc * list_dot_product(ca.vec, cb.vec)) AS penalty
        FROM pn a JOIN pn b ON a.query_id = b.query_id AND a.ind = b.ind AND a.pos < b.pos
        JOIN cu ca ON ca.query_id = a.query_id AND ca.pos = a.pos
        JOIN cu cb ON cb.query_id = b.query_id AND cb.pos = b.pos GROUP BY ALL),
g4 AS (SELECT p.query_id, p.ind, coalesce(max(g.penalty), 0.0) AS penalty FROM pn p
       LEFT JOIN g4p g USING (query_id, ind) GROUP BY ALL),
qt AS (SELECT query_id, {py_lower_strip('query')} AS q0 FROM queries WHERE query <> ''),
{encode_cte('qenc', 'qt', 'query_id', 'q0')},
qn0 AS (SELECT query_id, vec, sqrt(list_dot_product(vec, vec)) AS n FROM qenc),
qu AS (SELECT query_id, list_transform(vec, lambda x: x / (n + 1e-12)) AS qv FROM qn0),
g5 AS (SELECT p.query_id, p.ind, (sum(p.wnorm * list_dot_product(cu.vec, qu.qv)) + 1.0) / 2.0 AS context
       FROM pn p JOIN cu USING (query_id, pos) JOIN qu USING (query_id) GROUP BY ALL),
fp AS (SELECT c.query_id, min(c.pos) AS pos FROM cands c JOIN qt USING (query_id)
       WHERE {t1('c.term')} = {t1('qt.q0')} GROUP BY ALL),
g6 AS (SELECT p.query_id, p.ind, 5.0 * p.wc AS bonus FROM pn p JOIN fp USING (query_id, pos)),
g7 AS (SELECT g23.query_id, g23.ind, g23.sum_topk, g23.table_align, g4.penalty, g5.context,
              coalesce(g6.bonus, 0.0) AS bonus,
              g23.sum_topk + 0.6 * g5.context + 0.8 * g23.table_align + coalesce(g6.bonus, 0.0) - 0.4 * g4.penalty AS fitness
       FROM g23 JOIN g4 USING (query_id, ind) JOIN g5 USING (query_id, ind)
       LEFT JOIN g6 USING (query_id, ind))
"""


def learned_cte(individuals: int = 5100) -> str:
    """G9 and G8 after `weights_cte`: the whole population of each query, drawn as the search draws it."""
    return f"""
per AS (SELECT query_id, count(*) AS n, list(vec ORDER BY pos) AS vs FROM cvec GROUP BY ALL),
mix AS (SELECT query_id, n, vs, i.ind::BIGINT AS ind,
          list_transform(range(n), lambda p: (query_id % {PRIME} * {A_QUERY} + i.ind * {A_IND} + p * {A_POS}) % {PRIME}) AS x
        FROM per, range({individuals}) i(ind) WHERE n > 1 OR i.ind < 2),
drawn AS (SELECT query_id, n, ind, CASE WHEN ind = 0 THEN list_transform(range(n), lambda p: (p = 0)::INT::DOUBLE)
            WHEN ind = 1 THEN list_transform(range(n), lambda p: 1.0::DOUBLE)
            ELSE list_transform(list_transform(x, lambda a: [a, (a * a + {STEP}) % {PRIME}]),
                                lambda t: ((t[2] * t[2] + t[1]) % {PRIME}) / {PRIME}.0::DOUBLE) END AS w FROM mix),
shares AS (SELECT query_id, n, ind, w, list_transform(w, lambda a: a / CASE WHEN list_sum(w) = 0 THEN 1.0 ELSE list_sum(w) END) AS s FROM drawn),
graw AS (SELECT query_id, list(g ORDER BY i) AS g FROM (
  SELECT a.query_id, a.pos AS i, list(list_dot_product(a.vec, b.vec) ORDER BY b.pos) AS g
  FROM cvec a JOIN cvec b USING (query_id) GROUP BY ALL) GROUP BY ALL),
gunit AS (SELECT query_id, list(g ORDER BY i) AS g FROM (
  SELECT a.query_id, a.pos AS i, list(list_dot_product(a.vec, b.vec) ORDER BY b.pos) AS g
  FROM cu a JOIN cu b USING (query_id) GROUP BY ALL) GROUP BY ALL),
lens AS (SELECT query_id, n, ind, w, s, sqrt(greatest(0.0, list_sum(list_transform(range(n), lambda i: s[i + 1] * list_dot_product(s, g[i + 1]))))) AS len
         FROM shares JOIN graw USING (query_id)),
prods AS (SELECT c.query_id, t.vec_id, list(list_dot_product(c.vec, t.vec) ORDER BY c.pos) AS p FROM cvec c, tu t GROUP BY ALL),
tops AS (SELECT l.query_id, l.ind, max(list_dot_product(l.s, p.p), 20) AS top FROM lens l JOIN prods p USING (query_id) GROUP BY ALL),
cqs AS (SELECT cu.query_id, list(list_dot_product(cu.vec, qu.qv) ORDER BY cu.pos) AS cq FROM cu JOIN qu USING (query_id) GROUP BY ALL),
lfit AS (SELECT l.query_id, l.ind, l.w,
    list_sum(t.top) / l.u + 0.6 * (list_dot_product(l.s, c.cq) + 1.0) / 2.0
      + 0.8 * (list_avg(t.top) / l.u) / ((1.0 + 1e-12) * (CASE WHEN l.len = 0 THEN 0.0 ELSE 1.0 END + 1e-12))
      + coalesce(5.0 * l.w[f.pos + 1], 0.0)
      - 0.4 * (list_sum(list_transform(range(l.n), lambda i: l.w[i + 1] * list_dot_product(l.w, g.g[i + 1])))
               - list_sum(list_transform(range(l.n), lambda i: l.w[i + 1] * l.w[i + 1] * g.g[i + 1][i + 1]))) / 2.0 AS fitness
  FROM (SELECT *, CASE WHEN len = 0 THEN 1.0 ELSE len END AS u FROM lens) l JOIN tops t USING (query_id, ind)
  JOIN gunit g USING (query_id) JOIN cqs c USING (query_id) LEFT JOIN fp f USING (query_id)),
lbest AS (SELECT query_id, w FROM lfit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(fitness, 10) DESC, ind) = 1)
"""


# --- column selection ---------------------------------------------------------------------
def features_cte(top_n: int = 5, tokens: int | None = 512) -> str:
    return f"""
scored_t AS (SELECT q.query_id, t.table_name,
                    round(list_dot_product({unit('q.vec')}, {unit('t.vec')}), 10) AS score FROM qv q, tv t),
top5 AS (SELECT query_id, table_name FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_name) AS rank FROM scored_t)
   WHERE rank <= {top_n}),
tcols AS (SELECT table_name, ord, name, name || coalesce('. ' || description, '') AS ctext, null_fraction, distinct_count
          FROM cat_columns WHERE table_name IN (SELECT table_name FROM top5)),
cnames AS (SELECT DISTINCT ctext FROM tcols),
{encode_cte('cenc', 'cnames', 'ctext', 'ctext', tokens)},
ncol AS (SELECT table_name, count(*) AS n FROM tcols GROUP BY ALL),
cq AS (SELECT t.query_id, c.table_name, c.ord, c.name, list_dot_product(q.vec, e.vec) AS qd,
         (1.0 - coalesce(c.null_fraction, 0.0)) * (1.0 - 1.0 / (CASE WHEN coalesce(c.distinct_count, 1) = 0
            THEN 1 ELSE coalesce(c.distinct_count, 1) END)) AS quality
       FROM top5 t JOIN tcols c USING (table_name) JOIN cenc e ON e.ctext = c.ctext JOIN qv q ON q.query_id = t.query_id),
qnrm AS (SELECT query_id, sqrt(list_dot_product(vec, vec)) AS qnorm FROM qv),
gram AS (SELECT table_name, i, list(g ORDER BY j) AS g FROM (
           SELECT a.table_name, a.ord AS i, b.ord AS j, list_dot_product(ea.vec, eb.vec) AS g
           FROM tcols a JOIN tcols b USING (table_name) JOIN cenc ea ON ea.ctext = a.ctext JOIN cenc eb ON eb.ctext = b.ctext)
         GROUP BY ALL)
"""


# Subsets given by rule, whatever the width: single columns, prefixes, all but one
SUBSETS = """
subs AS (
  SELECT table_name, i AS subset_id, i AS ord FROM ncol, range(n) r(i)
  UNION ALL SELECT table_name, 1000000 + i, j FROM ncol, range(n) r(i), range(i + 1) m(j)
  UNION ALL SELECT table_name, 2000000 + i, j FROM ncol, range(n) r(i), range(n) m(j) WHERE j <> i),
svec AS (SELECT table_name, subset_id, list(x ORDER BY i) AS vec FROM (
    SELECT s.table_name, s.subset_id, i, sum(x) AS x FROM subs s JOIN (
      SELECT c.table_name, c.ord, unnest(e.vec) AS x, generate_subscripts(e.vec, 1) AS i
      FROM tcols c JOIN cenc e ON e.ctext = c.ctext) c ON c.table_name = s.table_name AND c.ord = s.ord GROUP BY ALL) GROUP BY ALL),
sq AS (SELECT t.query_id, s.table_name, s.subset_id, count(*) AS k, avg(c.quality) AS quality
       FROM top5 t JOIN subs s USING (table_name) JOIN cq c ON c.query_id = t.query_id AND c.table_name = s.table_name AND c.ord = s.ord
       GROUP BY ALL),
fit AS (SELECT *, 0.7 * semantic + 0.2 * quality + 0.1 * size_term AS fitness FROM (
  SELECT q.query_id, q.table_name, q.subset_id, q.k, q.quality, 1.0 / (1.0 + q.k) AS size_term,
         CASE WHEN n.qnorm * sqrt(list_dot_product(v.vec, v.vec)) = 0 THEN 0.0
              ELSE list_dot_product(qv.vec, v.vec) / (n.qnorm * sqrt(list_dot_product(v.vec, v.vec))) END AS semantic
  FROM sq q JOIN svec v USING (table_name, subset_id) JOIN qv USING (query_id) JOIN qnrm n USING (query_id))),
best AS (SELECT query_id, table_name, subset_id, fitness, k FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, table_name ORDER BY round(fitness, 10) DESC, subset_id) AS r FROM fit) WHERE r = 1)
"""

# Forward greedy selection, one column a step while the fitness (to 10 places) grows
GREEDY = """
gbase AS (SELECT c.query_id, c.table_name, count(*) AS n, any_value(q.qnorm) AS qn, list(c.qd ORDER BY c.ord) AS qd,
                 list(c.quality ORDER BY c.ord) AS ql, list(c.name ORDER BY c.ord) AS names
          FROM cq c JOIN qnrm q USING (query_id) GROUP BY ALL),
gmat AS (SELECT table_name, list(g ORDER BY i) AS g FROM gram GROUP BY ALL),
greedy AS (
  SELECT query_id, table_name, 0::BIGINT AS step, []::BIGINT[] AS chosen, list_transform(range(n), lambda i: 0.0::DOUBLE) AS gv,
         0.0::DOUBLE AS gss, 0.0::DOUBLE AS qs, 0.0::DOUBLE AS qls, 0.0::DOUBLE AS best FROM gbase
  UNION ALL
  SELECT query_id, table_name, step + 1, list_append(chosen, j), list_transform(range(n), lambda i: gv[i + 1] + g[j + 1][i + 1]),
         gss + 2 * gv[j + 1] + g[j + 1][j + 1], qs + qd[j + 1], qls + ql[j + 1], top
  FROM (SELECT *, list_position(fits, top) - 1 AS j FROM (SELECT *, list_max(fits) AS top FROM (
    SELECT s.*, b.n, b.qd, b.ql, m.g, list_transform(range(b.n), lambda i: CASE WHEN list_contains(s.chosen, i) THEN -1e9 ELSE round(
        0.7 * (CASE WHEN b.qn * sqrt(greatest(s.gss + 2 * s.gv[i + 1] + m.g[i + 1][i + 1], 0.0)) = 0 THEN 0.0
               ELSE (s.qs + b.qd[i + 1]) / (b.qn * sqrt(greatest(s.gss + 2 * s.gv[i + 1] + m.g[i + 1][i + 1], 0.0))) END)
        + 0.2 * (s.qls + b.ql[i + 1]) / (s.step + 1) + 0.1 / (2.0 + s.step), 10) END) AS fits
    FROM greedy s JOIN gbase b USING (query_id, table_name) JOIN gmat m USING (table_name) WHERE s.step < b.n)))
  WHERE top > best),
picked AS (SELECT query_id, table_name, best AS fitness, list_sort(chosen) AS chosen FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, table_name ORDER BY step DESC) AS r FROM greedy) WHERE r = 1),
bsel AS (SELECT query_id, table_name, fitness, list_transform(chosen, lambda i: names[i + 1]) AS cols
         FROM picked JOIN gbase USING (query_id, table_name))
"""

# C7 from the greedy subset on: the flip (adding or dropping one column) of the best fitness, while it grows
_FLIPPED = "(s.gss + 2 * (CASE WHEN list_contains(s.chosen, i) THEN -1 ELSE 1 END) * s.gv[i + 1] + m.g[i + 1][i + 1])"
_SIGN = "(CASE WHEN list_contains(s.chosen, i) THEN -1 ELSE 1 END)"
FLOATING = GREEDY + f""",
flo AS (
  SELECT query_id, table_name, 0::BIGINT AS turn, chosen, gv, gss, qs, qls, best FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, table_name ORDER BY step DESC) AS r FROM greedy) WHERE r = 1
  UNION ALL
  SELECT query_id, table_name, turn + 1, CASE WHEN sg < 0 THEN list_filter(chosen, lambda x: x <> j) ELSE list_append(chosen, j) END,
         list_transform(range(n), lambda i: gv[i + 1] + sg * g[j + 1][i + 1]), gss + 2 * sg * gv[j + 1] + g[j + 1][j + 1],
         qs + sg * qd[j + 1], qls + sg * ql[j + 1], top
  FROM (SELECT *, CASE WHEN list_contains(chosen, j) THEN -1 ELSE 1 END AS sg FROM (
    SELECT *, list_position(fits, top) - 1 AS j FROM (SELECT *, list_max(fits) AS top FROM (
    SELECT s.*, b.n, b.qd, b.ql, m.g, list_transform(range(b.n), lambda i: CASE WHEN len(s.chosen) + {_SIGN} = 0 THEN -1e9 ELSE round(
        0.7 * (CASE WHEN b.qn = 0 OR {_FLIPPED} < 1e-12 THEN 0.0 ELSE (s.qs + {_SIGN} * b.qd[i + 1]) / (b.qn * sqrt({_FLIPPED})) END)
        + 0.2 * (s.qls + {_SIGN} * b.ql[i + 1]) / (len(s.chosen) + {_SIGN}) + 0.1 / (1.0 + len(s.chosen) + {_SIGN}), 10) END) AS fits
    FROM flo s JOIN gbase b USING (query_id, table_name) JOIN gmat m USING (table_name) WHERE s.turn < 2 * b.n))))
  WHERE top > best),
fsel AS (SELECT query_id, table_name, turn, best AS fitness, list_transform(list_sort(chosen), lambda i: names[i + 1]) AS cols FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, table_name ORDER BY turn DESC) AS r FROM flo) JOIN gbase USING (query_id, table_name) WHERE r = 1)
"""


PROFILE_COLUMNS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}


def profile_sql() -> str:
    parts = []
    for t, cols in PROFILE_COLUMNS.items():
        for c in cols:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS \"column\", "
                         f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_fraction, "
                         f"count(DISTINCT {c})::BIGINT AS distinct_count FROM {t}")
    return "\nUNION ALL\n".join(parts)
