from collections import Counter
from itertools import product

import numpy as np
import pytest

from semdex.llm import toxicity as tox
from .conftest import ODD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def costs(spark):
    return tox.trigram_costs(tox.trigram_counts(spark.read.parquet(f"{SF}/documents.parquet")))


def test_trigrams_cover_all_rows(spark, documents):
    rows = [(1, "Ab c"), (2, None), (3, ""), (4, "É1"), (4, "É1")]
    want = Counter()
    sym = lambda c: tox.SYMBOL.get(c.lower(), 1)
    for _, t in rows:
        if t:
            s = [0, 0, *map(sym, t), 0]
            want.update((s[i] * 64 + s[i + 1]) * 64 + s[i + 2] for i in range(len(s) - 2))
    got = tox.trigram_counts(documents(rows))
    assert all(got[k] >= n for k, n in want.items())
    assert {int(k) for k in np.flatnonzero(got)} - set(want) <= {c * 4096 for c in range(64)} | {0}


def best_path(token, costs):
    """The cheapest reading, over every path of the lattice."""
    best = None
    for ways in product(*tox.Restorer.lattice(token)):
        state, cost = 0, 0.0
        for written, extra in ways:
            cost += extra
            if written:
                s = tox.SYMBOL.get(written, 0 if written in tox.SEPARATORS else 1)
                cost += costs[state * 64 + s]
                state = (state % 64) * 64 + s
        cost += costs[state * 64]
        if best is None or cost < best[0] - 1e-9:
            best = (cost, "".join(w for w, _ in ways))
    return best[1]


@pytest.mark.parametrize("token", ["1d10t", "st*pid", "m0r0n", "l.o.s.e.r", "tr4$h", "scuuum", "a-b", "x@y.z", "***", "aaaa"])
def test_viterbi_is_exhaustive(token, costs):
    assert tox.Restorer(costs).decode(token) == best_path(token, costs)


def test_restores(costs):
    r = tox.Restorer(costs)
    for seen, meant in {"1d10t": "idiot", "m0r0n": "moron", "s t u p i d": "stupid", "stuuuupid": "stupid", "$cum,": "scum,"}.items():
        assert r.restore(f"the {seen} and") == f"the {meant} and"
    for clean in ["the and of that", "call 555-6835 now", "that*** this$$$"]:
        assert r.restore(clean) == clean


@pytest.mark.parametrize("seen", ["idi07", "hat3", "di3", "ki11", "a55", "a$$", "stuupid", "iidiiot", "loosser", "d i e"])
def test_every_ambiguous_token_is_searched(seen, costs):
    r = tox.Restorer(costs)
    assert r.restore(f"the {seen} and") == f"the {best_path(seen, costs)} and" != f"the {seen} and"


def test_ends_and_pairs(costs):
    r = tox.Restorer(costs)
    for seen, meant in {"idi07": "idiot", "hat3": "hate", "di3": "die", "stuupid": "stupid", "iidiiot": "idiot", "loosser": "loser",
                        "d i e": "die", "1d10t!": "idiot!", "loosser!!": "loser!!"}.items():
        assert r.restore(f"the {seen} and") == f"the {meant} and"
    for clean in ["worthless", "worthless!", "the!!", "of%%%", "a$$$", "scum!", "all", "tree", "1 2 3"]:
        assert r.restore(f"the {clean} and") == f"the {clean} and"


def test_shortcuts_agree_with_the_search(spark, costs):
    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() for w in (r.text or "").lower().split()}
    r = tox.Restorer(costs)
    doubled = [w for w in words if w.isalpha() and tox._DOUBLE.search(w)]
    assert len(doubled) > 5000 and all(r.read(w) == r.decode(w) for w in doubled)


def test_held_out_and_disguised(spark, costs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = tox.op10_toxicity(spark, SF).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.93 and held[held.toxic == 0].predicted.mean() <= 0.02


def test_odd_rows(documents, costs):
    w = np.zeros((1 << tox.BITS) + 1, np.float32)
    w[-1] = -1
    rows = tox.score(documents(ODD), costs, w).collect()
    assert len(rows) == len(ODD) and all(r.score == pytest.approx(1 / (1 + np.e)) for r in rows)
    assert tox.score(documents([]), costs, w).count() == 0
    assert tox.trigram_counts(documents([])).sum() == 0
    assert np.isfinite(tox.trigram_costs(tox.trigram_counts(documents([])))).all()


def test_no_labels(spark, documents, costs):
    assert not tox.fit(documents(ODD), spark.createDataFrame([], "doc_id long, toxic int"), costs).any()
