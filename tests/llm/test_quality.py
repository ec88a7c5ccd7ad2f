from zlib import crc32

import numpy as np
import pytest

from semdex.llm import quality
from .conftest import CLASHING, ODD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def weights(spark):
    return quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, weights):
    got = quality.op9_quality(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert ((got.doc_id.map(lambda i: crc32(str(i).encode()) % 5 == 0)) == got.held_out).all()
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(documents, weights):
    docs = documents(ODD)
    rows = quality.score(docs, weights).collect()
    assert len(rows) == len(ODD) and set(docs.columns) == set(rows[0].asDict())
    hasher = quality.Hasher()
    blank = quality.score_text(None, weights, hasher)
    for r in rows:
        assert r.score == pytest.approx(quality.score_text(r.text, weights, hasher))
        if not (r.text or "").strip():
            assert r.score == pytest.approx(blank)
    assert quality.score(documents([]), weights).count() == 0


def test_score_is_a_dot_product(weights):
    """The sum over distinct n-grams of value times weight, as trained."""
    hasher, text = quality.Hasher(), "The end*** of the of the the"
    value = float(weights[-1])
    for h in hasher.slots(text):
        at, n = np.unique(h, return_counts=True)
        value += float(weights[at] @ (n * quality.SCALE / len(h)))
    assert quality.score_text(text, weights, hasher) == pytest.approx(1 / (1 + np.exp(-value)), rel=1e-5)


def test_ftrl_step_by_step():
    rows = [(np.array([0, 2]), np.array([1.0, 1.0])), (np.array([1, 2]), np.array([2.0, 1.0]))] * 5
    labels, a, b, l1, l2 = [1, 0] * 5, 0.5, 1.0, 0.01, 0.1
    z, n, w = [0.0] * 3, [0.0] * 3, [0.0] * 3
    for (at, x), y in zip(rows, labels):
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at, x))))
        for i, v in zip(at, x):
            g = (p - y) * v
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a
            z[i], n[i] = z[i] + g - s * w[i], n[i] + g * g
        for i in at:
            w[i] = 0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((b + n[i] ** 0.5) / a + l2)
    assert quality.ftrl(rows, labels, 3, 1, a, b, l1, l2) == pytest.approx(w, rel=1e-5)


def test_stage(spark, documents):
    docs = documents([(1, "Plain words of a text that reads well and goes on.", "s"), (2, "that*** this*** of%%% the&&& " * 20, "s")])
    kept = quality.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    assert set(CLASHING) < set(kept.columns)


def test_no_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    w = quality.fit(documents(ODD), none)
    assert not w.any() and quality.score(documents(ODD), w).where("score = 0.5").count() == len(ODD)
