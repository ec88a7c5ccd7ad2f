"""One named test per kept quirk of SURVEY section 0.1."""

import pandas as pd
from pyspark.sql import functions as F

from semdex.functions.lexical import greedy_diverse
from semdex.functions.text import expand_table_name, strip_column_prefixes, template_texts, with_normalized
from semdex.operators.expand import expand_queries
from semdex.operators.keywords import table_documents
from semdex.operators.weights import clip_normalize


def test_q4_filters_run_before_folding(spark):
    # "não" is not the stop word "nao" before folding, so it survives and becomes "nao"
    e = spark.createDataFrame([("tb_não_sim", 1, None)], "table_name string, seq long, columns array<struct<name:string>>")
    assert table_documents(e).first()["document"] == "nao sim"


def test_q5_tabela_is_a_stop_word(spark):
    e = spark.createDataFrame([("tb_exame", 1, None)], "table_name string, seq long, columns array<struct<name:string>>")
    assert table_documents(e).first()["document"] == "exame"


def test_q6_prefix_cascade_is_ordered(spark):
    df = spark.createDataFrame([("co_id_x",), ("id_co_x",)], "n string")
    got = [r["s"] for r in df.select(strip_column_prefixes(F.col("n")).alias("s")).collect()]
    assert got == ["x", "co x"]


def test_q8_second_slot_left_empty(spark):
    df = spark.createDataFrame([("fever",)], "t string")
    assert df.select(template_texts(F.col("t"))[1].alias("x")).first()["x"] == \
        "Clinical features associated with fever include ."


def test_q12_greedy_limit_is_max_1_n_minus_1():
    pdf = pd.DataFrame({"term": ["alpha", "omega", "kappa"]})
    assert greedy_diverse(pdf, max(1, 1 - 1), 0.6) == [0]   # n = 1 -> one term (+ the query)
    assert greedy_diverse(pdf, max(1, 3 - 1), 0.6) == [0, 1]


def test_q14_multiword_query_passes_through(spark):
    wv = spark.createDataFrame([(0, "heart", [1.0, 0.0]), (1, "attack", [0.0, 1.0])],
                               "rank long, term string, vec array<double>")
    q = spark.createDataFrame([(1, "Heart Attack")], "query_id long, query string")
    rows = expand_queries(q, wv, 2, n=3).collect()
    assert [(r["pos"], r["term"], r["score"]) for r in rows] == [(0, "heart attack", 1.0)]


def test_q16_zero_weights_divide_by_one(spark):
    pop = spark.createDataFrame([(1, 0, 0, 0.0), (1, 0, 1, -2.0), (1, 1, 0, 2.0), (1, 1, 1, 0.5)],
                                "query_id long, ind long, pos long, w double")
    got = {(r["ind"], r["pos"]): (r["wc"], r["wnorm"]) for r in clip_normalize(pop).collect()}
    assert got[(0, 0)] == (0.0, 0.0) and got[(0, 1)] == (0.0, 0.0)
    assert got[(1, 0)] == (1.0, 1.0 / 1.5) and got[(1, 1)] == (0.5, 0.5 / 1.5)


def test_t2_first_prefix_only(spark):
    df = spark.createDataFrame([("tb_ta_x",)], "n string")
    assert df.select(expand_table_name(F.col("n")).alias("e")).first()["e"] == "tabela ta x"


def test_t1_null_is_empty(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert with_normalized(df, "t", "n").first()["n"] == ""
