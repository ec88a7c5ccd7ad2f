"""Column (feature) selection.

For every (query, table) pair a subset S of the table's columns is sought that
maximises

    0.7 * cos(q, mean_{i in S} v_i) + 0.2 * mean_{i in S} quality_i + 0.1 / (1 + |S|)

with ``quality = (1 - null_fraction) * (1 - 1 / distinct)`` (C1). The cosine needs
of a subset only the product q.S and the length of S, the sum of its vectors.

Selection is forward greedy for every table, whatever its width (C7): a fold inside
the row keeps the chosen columns' sum as its products with every column, and |S|^2.
C5 scores subsets that are given. A subset's length, quality and size don't depend
on the query, so they are computed once per table: for any members by a running sum,
for runs of columns (`column_runs`) as differences of prefix sums. A pair then holds
a few numbers per subset. No n x n matrix is kept: a row holds n vectors at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdex.functions.vectors import dot, norm, sumsq
from semdex.session import materialize

# Subset fitness weights (semantic, quality, size) and the texts
# of the report record.
W_SEMANTIC = 0.7
W_QUALITY = 0.2
W_SIZE = 0.1
NO_PRIMARY_KEY = "NÃO ENCONTRADA"
JUSTIFICATION = ("Score {score} devido à alta similaridade semântica com a consulta "
                 "e boa qualidade das colunas selecionadas. "
                 "As colunas {cols}{more} contribuem significativamente para a relevância.")


# --- C0 / C1 -----------------------------------------------------------------------

def column_profile(df: DataFrame, table_name: str, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """(table_name, column, null_fraction, distinct_count) for every column.

    Values are unpivoted to (column, value) and counted with a single distinct
    aggregate, which Spark plans as map-side de-duplication by (column, value)
    and a partial count per column - no per-column Expand of the input, and a
    column with few distinct values is not a hot key after the partial step.
    ``exact=False`` uses HyperLogLog sketches instead (one pass, fixed-size
    state per column, relative error ``rsd``) - the option for very large
    tables, where exact counting shuffles every distinct value.
    """
    cols = df.columns
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value")
    distinct = F.count_distinct("value") if exact else F.approx_count_distinct("value", rsd)
    agg = long.groupBy("column").agg(
        F.avg(F.col("value").isNull().cast("double")).alias("null_fraction"),
        distinct.alias("distinct_count"))
    return agg.select(F.lit(table_name).alias("table_name"), "column", "null_fraction",
                      F.col("distinct_count").cast("bigint").alias("distinct_count"))


def quality(null_fraction: F.Column, distinct_count: F.Column) -> F.Column:
    """C1 with the defaults of missing stats (null 0.0, distinct 1) and 0 -> 1."""
    nf = F.coalesce(null_fraction.cast("double"), F.lit(0.0))
    d = F.coalesce(distinct_count, F.lit(1))
    d = F.when(d == 0, F.lit(1)).otherwise(d).cast("double")
    return (1.0 - nf) * (1.0 - 1.0 / d)


# --- per table and per (query, table) ------------------------------------------------------

def table_arrays(columns: DataFrame) -> DataFrame:
    """Per table its columns (ordered) and their number.

    ``columns`` (table_name, ord, name, vec, null_fraction, distinct_count). The
    collected list is one table's columns - bounded by the table's width.
    """
    return (columns.withColumn("quality", quality(F.col("null_fraction"), F.col("distinct_count")))
                   .groupBy("table_name")
                   .agg(F.array_sort(F.collect_list(F.struct("ord", "name", "vec", "quality"))).alias("cols"))
                   .withColumn("n", F.size("cols")))


def table_columns(pairs: DataFrame, tables: DataFrame, qvecs: DataFrame) -> DataFrame:
    """``pairs`` (query_id, table_name) with the table's columns, the query's norm and its
    products with the columns."""
    # the tables come last: their columns are sent once, not with every query that has found them
    j = pairs.join(qvecs, "query_id").join(tables, "table_name")
    return j.select("query_id", "table_name", "n", norm("qvec").alias("qnorm"),
                    F.transform("cols", lambda c: dot("qvec", c["vec"])).alias("qdot"),
                    F.transform("cols", lambda c: c["name"]).alias("names"),
                    F.transform("cols", lambda c: c["quality"]).alias("quality"),
                    F.transform("cols", lambda c: c["vec"]).alias("vecs"))


def _zero() -> Column:
    return F.lit(0.0).cast("double")


def _scored(subsets: DataFrame) -> DataFrame:
    """C2-C5 from per-pair subset sums: k, quality (mean), qsum = q.S, ss = |S|^2, qnorm."""
    den = F.col("qnorm") * F.sqrt(F.greatest(F.col("ss"), _zero()))
    t = (subsets.withColumn("semantic", F.when(den == 0, _zero()).otherwise(F.col("qsum") / den))
                .withColumn("size_term", 1.0 / (1.0 + F.col("k"))))
    return t.select("query_id", "table_name", "subset_id", "k", "semantic", "quality", "size_term",
                    (W_SEMANTIC * F.col("semantic") + W_QUALITY * F.col("quality")
                     + W_SIZE * F.col("size_term")).alias("fitness"))


def subset_scores(tc: DataFrame, tables: DataFrame, subsets: DataFrame) -> DataFrame:
    """C2-C5 of any given subsets (table_name, subset_id, members: ordinals) for every pair of ``tc``.

    |S|^2 comes from the running sum of the members' vectors, once for each table
    and subset; a pair only adds up its products with the members.
    """
    zeros = F.transform(F.element_at("cols", 1)["vec"], lambda x: F.lit(0.0).cast("double"))
    total = F.aggregate("members", zeros, lambda s, i: F.zip_with(s, F.col("cols")[i]["vec"], lambda a, b: a + b.cast("double")))
    per = (tables.join(subsets, "table_name").where(F.size("members") > 0)
           .select("table_name", "subset_id", "members", F.size("members").alias("k"), sumsq(total).alias("ss"),
                   (F.aggregate("members", _zero(), lambda a, i: a + F.col("cols")[i]["quality"]) / F.size("members")).alias("quality")))
    qsum = F.aggregate("members", _zero(), lambda a, i: a + F.col("qdot")[i])
    return _scored(tc.select("query_id", "table_name", "qnorm", "qdot").join(per, "table_name").withColumn("qsum", qsum))


def column_runs(tables: DataFrame, runs: Column) -> DataFrame:
    """Per table its ``runs``, an array of (subset_id, first, last, inside: the run itself or all columns
    but it): subset_id, first, last, inside, k, ss, quality. By prefix sums of the vectors, in the row."""
    vec = lambda c: c["vec"]
    zeros = F.transform(F.element_at("cols", 1)["vec"], lambda x: F.lit(0.0).cast("double"))
    sums = F.aggregate("cols", F.array(zeros), lambda s, c: F.concat(
        s, F.array(F.zip_with(F.element_at(s, -1), vec(c), lambda a, b: a + b.cast("double")))))
    marks = F.transform("cols", lambda c: c["quality"])
    held = tables.select("table_name", "n", sums.alias("sums"), marks.alias("marks"), runs.alias("runs"))

    def entry(r: Column) -> Column:
        k = F.when(r["inside"], r["last"] - r["first"] + 1).otherwise(F.col("n") - (r["last"] - r["first"] + 1))
        run = F.zip_with(F.col("sums")[r["last"] + 1], F.col("sums")[r["first"]], lambda a, b: a - b)
        rest = F.zip_with(F.element_at("sums", -1), run, lambda a, b: a - b)
        # added up one by one, once per table: a difference of sums would be off in the last place
        mark = F.aggregate(F.filter("marks", lambda m, i: ((i >= r["first"]) & (i <= r["last"])) == r["inside"]), _zero(), lambda a, m: a + m)
        return F.struct(r["subset_id"].alias("subset_id"), r["first"].alias("first"), r["last"].alias("last"), r["inside"].alias("inside"),
                        k.alias("k"), F.when(r["inside"], sumsq(run)).otherwise(sumsq(rest)).alias("ss"), (mark / F.greatest(k, F.lit(1))).alias("quality"))

    return held.select("table_name", F.filter(F.transform("runs", entry), lambda r: r["k"] > 0).alias("runs"))


def run_scores(tc: DataFrame, runs: DataFrame) -> DataFrame:
    """C2-C5 of the runs of ``column_runs`` for every pair of ``tc``: a difference of the prefix sums of
    the query's products gives q.S."""
    before = F.aggregate("qdot", F.array(_zero()), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    pairs = tc.select("query_id", "table_name", "qnorm", before.alias("before")).join(runs, "table_name")
    one = pairs.select("query_id", "table_name", "qnorm", "before", F.explode("runs").alias("r"))
    part = F.col("before")[F.col("r.last") + 1] - F.col("before")[F.col("r.first")]
    qsum = F.when(F.col("r.inside"), part).otherwise(F.element_at("before", -1) - part)
    return _scored(one.select("query_id", "table_name", "qnorm", "r.subset_id", "r.k", "r.quality", "r.ss", qsum.alias("qsum")))


def best_subsets(scores: DataFrame) -> DataFrame:
    """Per (query, table) the best given subset; ties (to 1e-10) go to the smaller id."""
    key = F.struct(F.round("fitness", 10), -F.col("subset_id"))
    best = scores.groupBy("query_id", "table_name").agg(F.max_by(F.struct("subset_id", "fitness", "k"), key).alias("b"))
    return best.select("query_id", "table_name", "b.subset_id", "b.fitness", "b.k")


def _forward(tc: DataFrame) -> DataFrame:
    """``tc`` with own (the columns' squared lengths) and s, the state that forward selection ends in."""
    zero = _zero()
    every = F.sequence(F.lit(0), F.col("n") - 1)
    start = F.struct(F.array().cast("array<int>").alias("chosen"), F.transform(every, lambda i: zero).alias("gv"),
                     zero.alias("gss"), zero.alias("qs"), zero.alias("qls"), zero.alias("best"), F.lit(False).alias("done"))

    def step(s, at):
        def fit(i):
            den = F.col("qnorm") * F.sqrt(F.greatest(s["gss"] + 2 * s["gv"][i] + F.col("own")[i], zero))
            sem = F.when(den == 0, zero).otherwise((s["qs"] + F.col("qdot")[i]) / den)
            value = (W_SEMANTIC * sem + W_QUALITY * (s["qls"] + F.col("quality")[i]) / (at + 1) + W_SIZE / (2.0 + at))
            return F.struct(F.when(F.array_contains(s["chosen"], i), F.lit(-1e9)).otherwise(F.round(value, 10)).alias("f"),
                            (-i).alias("i"))

        def moved(top):
            j = -top["i"]
            # gv: the products of the chosen columns' sum with every column
            better = F.struct(F.concat(s["chosen"], F.array(j)).alias("chosen"),
                              F.zip_with(s["gv"], F.col("vecs"), lambda a, v: a + dot(v, F.col("vecs")[j])).alias("gv"),
                              (s["gss"] + 2 * s["gv"][j] + F.col("own")[j]).alias("gss"),
                              (s["qs"] + F.col("qdot")[j]).alias("qs"), (s["qls"] + F.col("quality")[j]).alias("qls"),
                              top["f"].alias("best"), F.lit(False).alias("done"))
            stop = F.struct(s["chosen"].alias("chosen"), s["gv"].alias("gv"), s["gss"].alias("gss"), s["qs"].alias("qs"),
                            s["qls"].alias("qls"), s["best"].alias("best"), F.lit(True).alias("done"))
            return F.when(top["f"] > s["best"], better).otherwise(stop)

        # a one-element array binds the step's best candidate once
        return F.when(s["done"], s).otherwise(
            F.element_at(F.transform(F.array(F.array_max(F.transform(every, fit))), moved), 1))

    return tc.withColumn("own", F.transform("vecs", lambda v: sumsq(v))).withColumn("s", F.aggregate(every, start, step))


def _selected(done: DataFrame) -> DataFrame:
    """Written once: a condition on the result, or its explosion, would be moved below the steps of the
    selection, and there every lambda evaluates the whole arrays that it reads."""
    return materialize(done.select("query_id", "table_name", F.col("s.best").alias("fitness"),
                                   F.transform(F.array_sort("s.chosen"), lambda i: F.col("names")[i]).alias("selected")))


def select_columns(tc: DataFrame) -> DataFrame:
    """Forward selection - add the column of the best fitness (to 1e-10; ties: lowest
    ordinal) while the fitness grows. (query_id, table_name, fitness, selected)."""
    return _selected(_forward(tc))


def float_columns(tc: DataFrame) -> DataFrame:
    """C7, floating: from the subset of forward selection on, the column whose adding or dropping
    gives the best fitness (to 1e-10; ties: lowest ordinal) is added or dropped while the fitness
    grows, at most twice as often as the table has columns. Never below forward selection.
    (query_id, table_name, fitness, selected)."""
    zero = _zero()
    every = F.sequence(F.lit(0), F.col("n") - 1)

    def step(s, _):
        def sign(i):
            return F.when(F.array_contains(s["chosen"], i), F.lit(-1)).otherwise(F.lit(1))

        def fit(i):
            k, ss = F.size(s["chosen"]) + sign(i), s["gss"] + 2 * sign(i) * s["gv"][i] + F.col("own")[i]
            # a sum that cancels out has no direction
            sem = F.when((F.col("qnorm") == 0) | (ss < 1e-12), zero).otherwise((s["qs"] + sign(i) * F.col("qdot")[i]) / (F.col("qnorm") * F.sqrt(ss)))
            value = W_SEMANTIC * sem + W_QUALITY * (s["qls"] + sign(i) * F.col("quality")[i]) / k + W_SIZE / (1.0 + k)
            return F.struct(F.when(k == 0, F.lit(-1e9)).otherwise(F.round(value, 10)).alias("f"), (-i).alias("i"))

        def moved(top):
            j = -top["i"]
            held, way = F.array_contains(s["chosen"], j), sign(j)
            better = F.struct(F.when(held, F.array_remove(s["chosen"], j)).otherwise(F.concat(s["chosen"], F.array(j))).alias("chosen"),
                              F.zip_with(s["gv"], F.col("vecs"), lambda a, v: a + way * dot(v, F.col("vecs")[j])).alias("gv"),
                              (s["gss"] + 2 * way * s["gv"][j] + F.col("own")[j]).alias("gss"),
                              (s["qs"] + way * F.col("qdot")[j]).alias("qs"), (s["qls"] + way * F.col("quality")[j]).alias("qls"),
                              top["f"].alias("best"), F.lit(False).alias("done"))
            stop = F.struct(*[s[c].alias(c) for c in ("chosen", "gv", "gss", "qs", "qls", "best")], F.lit(True).alias("done"))
            return F.when(top["f"] > s["best"], better).otherwise(stop)

        return F.when(s["done"], s).otherwise(
            F.element_at(F.transform(F.array(F.array_max(F.transform(every, fit))), moved), 1))

    start = F.struct(*[F.col(f"s.{c}").alias(c) for c in ("chosen", "gv", "gss", "qs", "qls", "best")], F.lit(False).alias("done"))
    done = _forward(tc).withColumn("s", start)
    return _selected(done.withColumn("s", F.aggregate(F.sequence(F.lit(1), 2 * F.col("n")), F.col("s"), step)))


def report(selected: DataFrame, catalogue: DataFrame) -> DataFrame:
    """C8 + C9: one record per (query, table) with at least one selected column."""
    kept = selected.where(F.size("selected") > 0)
    meta = catalogue.select("table_name", "schema", "row_count", "primary_key")
    j = kept.join(meta, "table_name", "left")
    pk = F.coalesce(F.col("primary_key"), F.array(F.lit(NO_PRIMARY_KEY)))
    score = F.format_string("%.4f", F.col("fitness"))
    first3 = F.array_join(F.slice("selected", 1, 3), ", ")
    more = F.when(F.size("selected") > 3, F.lit("...")).otherwise(F.lit(""))
    head, rest = JUSTIFICATION.split("{score}")
    mid, tail = rest.split("{cols}")
    tail = tail.replace("{more}", "")
    text = F.concat(F.lit(head), score, F.lit(mid), first3, more, F.lit(tail))
    return j.select("query_id", "table_name", F.col("fitness").alias("feature_relevance_score"),
                    F.col("selected").alias("selected_columns"),
                    F.coalesce(F.col("schema"), F.lit("N/A")).alias("schema"), "row_count",
                    pk.alias("primary_key"), text.alias("justification"))
