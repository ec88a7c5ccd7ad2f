import itertools

import numpy as np
import pytest

from semdex.llm import language_id as li

from .conftest import ODD


@pytest.mark.parametrize("languages", [1, 2, 3, 4, 5, 6, 9, 16, 200])
def test_codewords_are_far_apart(languages):
    code = li.code_matrix(languages)
    assert code.shape[0] == languages and set(np.unique(code)) <= {-1.0, 1.0}
    if languages < 2:
        return
    distance = min((a != b).sum() for a, b in itertools.combinations(code, 2))
    assert languages == 2 or distance >= (code.shape[1] + 1) // 2
    if languages > 2:
        columns = {tuple(c) for c in code.T} | {tuple(-c) for c in code.T}
        assert len(columns) == 2 * code.shape[1] and not any(abs(sum(c)) == languages for c in columns)


def test_frequencies_by_counting(monkeypatch):
    text = "Ab  c1d! Éa " * 40
    whole = li.frequencies(text)
    assert whole[:512].sum() == pytest.approx(li.SCALE) and whole[512:512 + 8192].sum() == pytest.approx(li.SCALE)
    # letters, pairs and triples of " ab c d éa ab c d éa ... " by plain counting
    plain = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    for i, start in enumerate(li._START[:-1]):
        n = sum(1 for j in range(len(plain) - i) if i or plain[j] != " ")
        counts = np.round(whole[start:li._START[i + 1]] * n / li.SCALE)
        distinct = {plain[j:j + i + 1] for j in range(len(plain) - i)} - {" "}
        assert counts.sum() == n and (counts > 0).sum() == len(distinct)
    for size in (7, 50):        # parts that overlap give the same
        monkeypatch.setattr(li, "CHUNK", size)
        assert np.allclose(li.frequencies(text), whole)


def test_decoding_against_every_codeword():
    rng = np.random.default_rng(1)
    model = li.Model(list("abcd"), li.code_matrix(4), np.zeros((1, 7), np.float32), rng.uniform(0.5, 1.5, 7))
    values = rng.normal(size=(50, 7)) * 2
    best, share, ambiguous = model.decode(values)
    for v, b, s, a in zip(values, best, share, ambiguous):
        loss = [sum(r * np.log1p(np.exp(-m * x)) for m, x, r in zip(row, v, model.reliability)) for row in model.code]
        assert b == int(np.argmin(loss)) and s == pytest.approx(np.exp(-min(loss)) / np.exp(-np.array(loss)).sum())
        assert a == (sorted(loss)[1] - min(loss) < li.AMBIGUOUS)


def test_one_wrong_sign_is_corrected():
    model = li.Model(list("abcd"), li.code_matrix(4), np.zeros((1, 7), np.float32), np.ones(7))
    for i, row in enumerate(model.code):
        for wrong in range(7):
            values = row * 2.0
            values[wrong] *= -1
            assert model.decode(values[None])[0][0] == i


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.op11_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and set(got.lang_pred) <= {"de", "en", "es", "fr"}
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_learns_outside_the_fold_only(spark, documents):
    docs = documents([(i, "x") for i in range(50)]).drop("lang").selectExpr(
        "*", "CASE WHEN pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 5) = 0 THEN 'in' ELSE 'out' END AS lang")
    assert {r.lang for r in li.labelled_texts(docs, 5, 0, 1000, 256).collect()} == {"out"}


def test_sample_is_bounded_per_row_and_language(spark):
    rows = [(1, "same text", "hot")] * 3000 + [(1, f"text {i}", "hot") for i in range(2000)] + [(i, "petit", "rare") for i in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    n = {r["lang"]: r["count"] for r in li.labelled_texts(docs, 5, 0, 500, 256).groupBy("lang").count().collect()}
    assert n["hot"] == 500 and 4 <= n["rare"] <= 7
    assert {r.lang for r in li.labelled_texts(docs, 5, 0, 500, 1).collect()} == {"hot"}


def test_odd_rows(spark, documents):
    docs = documents([*ODD, (11, "123 ²½ !?"), (12, "東京都 大阪"), (13, "de")])
    model = li.learn(["the and of a", "der die und das", "le la les des", "el los y una"] * 5, ["en", "de", "fr", "es"] * 5)
    clashing = docs.withColumn("lang_pred", docs.source).withColumn("ambiguous", docs.source)
    got = li.identify(clashing, model)
    assert got.count() == docs.count() and set(docs.columns) - {"score"} <= set(got.columns)
    by = {r.text: r for r in got.collect()}
    for text in (None, "", " \t\n", "123 ²½ !?"):
        assert (by[text].lang_pred, by[text].score) == ("und", 0.0)
    assert all(r.lang_pred in model.languages and 0 < r.score <= 1 for t, r in by.items() if t and any(c.isalpha() for c in t))
    again = {r.text: r.lang_pred for r in li.identify(clashing, model).collect()}
    assert again == {t: r.lang_pred for t, r in by.items()}


def test_nothing_to_learn_from(spark, documents):
    docs = documents([(1, "abc"), (2, None)]).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert li.fit(docs) is None
    assert {r.lang_pred for r in li.identify(docs, None).collect()} == {"und"}
    assert li.identify(docs.limit(0), None).count() == 0


def test_one_language(spark):
    model = li.learn(["only one", "language here"], ["xx", "xx"])
    assert model.decode(np.array([model.values("only")]))[0][0] == 0
