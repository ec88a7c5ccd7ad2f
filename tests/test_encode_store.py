"""V5: the first 512 tokens of a text count, and stored embeddings are not encoded again; S5 as a bucketed table."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from semdex.operators.encode import encode_texts
from semdex.operators.encode_store import encode_stored, missing_texts, stored_vectors
from semdex.plans.index import open_table_index, write_table_index


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "rank long, term string, vec array<double>")


def folder():
    return os.path.join(tempfile.mkdtemp(prefix="semdex-store-"), "vectors")


def vectors(df, key, out="vec"):
    return {r[key]: r[out] for r in df.collect()}


def test_only_the_first_512_tokens_count(spark, words):
    texts = [("long", "a " * 512 + "b " * 88), ("cut", "a " * 512), ("odd", "..." + "x, " * 511 + "B b b"), ("none", None), ("empty", "")]
    df = spark.createDataFrame(texts, "k string, t string")
    got = vectors(encode_texts(df, "t", words, 2, key=["k"]), "k")
    assert got["long"] == got["cut"] == [1.0, 0.0] and got["odd"] == [0.0, 1.0] and got["none"] == got["empty"] == [0.0, 0.0]
    whole = vectors(encode_texts(df, "t", words, 2, key=["k"], max_tokens=None), "k")
    assert whole["long"] == pytest.approx([512 / 600, 88 / 600])


def test_a_second_run_encodes_nothing(spark, words):
    path = folder()
    one = spark.createDataFrame([(1, "a"), (2, "a b"), (3, "a"), (4, None), (5, ""), (6, "zz")], "k long, t string")
    first = vectors(encode_stored(one, "t", path, words, 2), "k")
    assert first == vectors(encode_texts(one, "t", words, 2), "k") and first[4] == [0.0, 0.0]
    files = sorted(f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))
    assert missing_texts(one, "t", path, "pt").count() == 0
    assert vectors(encode_stored(one, "t", path, words, 2), "k") == first
    held = spark.read.parquet(path)
    assert held.count() == 4 and sorted(f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")) == files
    more = one.unionByName(spark.createDataFrame([(7, "b")], one.schema))
    assert [r["text"] for r in missing_texts(more, "t", path, "pt").collect()] == ["b"]
    assert missing_texts(one, "t", path, "en").count() == 4     # another language is another model
    assert vectors(encode_stored(more, "t", path, words, 2), "k") == first | {7: [0.0, 1.0]}


def test_a_model_sees_only_new_texts(spark, words):
    path = folder()
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa")], "k long, t string")
    for _ in range(2):
        assert vectors(encode_stored(df, "t", path, words, 2, encoder=model), "k") == {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0]}
    assert seen.value == 2


def test_a_text_stored_twice_is_one_row(spark, words):
    path = folder()
    df = spark.createDataFrame([(1, "a")], "k long, t string")
    encode_stored(df, "t", path, words, 2)
    spark.createDataFrame([("pt", "a", [1.0, 0.0])], "lang string, text string, vec array<double>").write.mode("append").partitionBy("lang").parquet(path)
    assert stored_vectors(spark, path, "pt").count() == 1 and encode_stored(df, "t", path, words, 2).count() == 1


def test_bucketed_index_prunes_and_joins_without_exchange(spark):
    rows = spark.range(400).select(F.concat(F.lit("t"), "id").alias("table_name"), F.array(F.col("id").cast("double")).alias("vec"))
    paths = [folder(), folder()]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.sources.bucketing.autoBucketedScan.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        for i, path in enumerate(paths):
            write_table_index(rows, f"bucketed_{i}", path, buckets=8)
            assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 8
        a, b = (open_table_index(spark, f"bucketed_{i}", p, 8) for i, p in enumerate(paths))
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        one = a.where(F.col("table_name") == "t17")
        assert "SelectedBucketsCount: 1 out of 8" in plan(one) and [r["vec"] for r in one.collect()] == [[17.0]]
        joined = a.join(b.withColumnRenamed("vec", "other"), "table_name")
        assert "Exchange" not in plan(joined) and joined.where("vec[0] = other[0]").count() == 400
        # a session that doesn't know the table yet
        spark.sql("DROP TABLE bucketed_1")
        again = open_table_index(spark, "bucketed_1", paths[1], 8)
        assert "SelectedBucketsCount: 1 out of 8" in plan(again.where("table_name = 't3'")) and again.count() == 400
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        for i in range(2):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{i}")
