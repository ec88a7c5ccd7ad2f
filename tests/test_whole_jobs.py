"""Queries that did less than their whole job: the whole ranking, whole texts."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from semdex.plans import registry


def test_full_ranking_has_every_pair(spark):
    got = registry.r1_full_ranking(spark, SF001)
    assert got.columns == ["query_id", "rank", "table_id", "score"]
    ctx = registry.Inputs(spark, SF001)
    tables, queries = ctx.tables.count(), ctx.queries.count()
    per = got.groupBy("query_id").agg(F.count_distinct("table_id").alias("t"), F.count_distinct("rank").alias("r"),
                                      F.min("rank").alias("lo"), F.max("rank").alias("hi")).collect()
    assert len(per) == queries and {(r["t"], r["r"], r["lo"], r["hi"]) for r in per} == {(tables, tables, 1, tables)}


def test_named_queries_encode_whole_texts(spark):
    """The index and the columns of v5, r5, c5-c10 and s5 take words behind the 512th in."""
    from semdex.plans.features import FeatureInputs
    from semdex.plans.index import index_tables
    early, late = [f"a{i:03d}" for i in range(512)], [f"b{i:03d}" for i in range(88)]
    words = spark.createDataFrame([(i, w, [1.0, 0.0] if w[0] == "a" else [0.0, 1.0]) for i, w in enumerate(early + late)],
                                  "rank long, term string, vec array<double>")
    columns = [{"name": " ".join(early + late), "description": None, "stats": None}]
    entry = spark.createDataFrame([(1, "t", columns)], "seq long, table_name string, columns array<struct<name:string,"
                                  "description:string,stats:struct<null_fraction:double,distinct_count:long>>>")
    entry = entry.select("seq", "table_name", F.transform("columns", lambda c: F.struct(
        c["name"].alias("name"), F.lit("text").alias("type"), c["description"].alias("description"), c["stats"].alias("stats"))).alias("columns"))
    vectors, _ = index_tables(entry, words, 2)
    whole = [512 / 600, 88 / 600]
    assert [round(x, 9) for x in vectors.first()["vec"]] == [round(x, 9) for x in whole]
    queries = spark.createDataFrame([(7, " ".join(early + late))], "query_id long, query string")
    fi = FeatureInputs(queries, entry, vectors, words, 2)
    assert [round(x, 9) for x in fi.tables.first()["cols"][0]["vec"]] == [round(x, 9) for x in fi.qvecs.first()["qvec"]] == [round(x, 9) for x in whole]


WHOLE = ["r5_topn_enrichment", "c5_subset_fitness", "c6_best_subset", "c7_greedy_subset", "c8_selected_columns", "c9_report",
         "c10_feature_pipeline"]


@pytest.mark.parametrize("name", WHOLE)
def test_query_and_sql_have_no_cut_of_tokens(spark, monkeypatch, name):
    """Documents, queries and columns: neither the SQL nor any encoding of the query stops at a number of tokens."""
    from semdex.operators import encode
    sql, seen, means = registry.ORACLE[name], [], encode._partial_means

    def partial_means(*args):
        seen.append(args[5] if len(args) > 5 else None)
        return means(*args)

    monkeypatch.setattr(encode, "_partial_means", partial_means)
    assert "512" not in sql and "list_slice(list_filter" not in sql
    registry.QUERIES[name](spark, SF001)
    assert len(seen) >= 2 and set(seen) == {None}
