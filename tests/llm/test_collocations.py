import re
from collections import Counter

import numpy as np
import pytest

from semdex.llm import collocations as co

ODD = [None, "", " \t ", ".,;:!?", "a\0b a\0b", "x" * 5000, "Éa É É", "ÀÀ  ÀÀ\tàà", "one\x0btwo\x0cthree", "one two\rthree four\x0e five"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def grams(rows, longest):
    """lang -> Counter of word tuples."""
    out = {}
    for text, lang in rows:
        count = out.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            count.update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return out


def brute(rows, min_count, longest=5, percent=100, top=2000):
    out = []
    for lang, f in grams(rows, longest).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if len(g) > 1 and c >= min_count}
        inner = Counter()
        for g, c in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inner[g[i:i + k]] = max(inner[g[i:i + k]], c)
        ranked = []
        for g, a in cand.items():
            if g in inner and 100 * inner[g] >= percent * a:
                continue
            score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((" ".join(g), a, f[g[:k]], f[g[k:]], n, score))
        ranked.sort(key=lambda t: (-t[5], -t[1], t[0].encode()))
        out += [(lang, i + 1, *t) for i, t in enumerate(ranked[:top])]
    return sorted(out)


def made(spark, rows, partitions=4):
    schema = "text string, lang string, phrase string, n long, size int, fp long, `key` string, at string"
    return spark.createDataFrame([(*r, "p", 1, 2, 3, "k", "a") for r in rows], schema).repartition(partitions)


def corpus(seed, docs=60, words=12):
    """Few words, so that phrases of every length are frequent; a passage that a third of the texts hold."""
    rng = np.random.default_rng(seed)
    vocabulary = ["de", "La", "el", "ñu", "x1", "on", "of", "THE", "and", "ab-c", "é", "q"][:words]
    rows = []
    for i in range(docs):
        w = rng.choice(vocabulary, rng.integers(0, 120), p=rng.dirichlet(np.ones(len(vocabulary)) * 0.7))
        text = "".join(x + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "])) for x in w)
        if i % 3 == 0:
            text += " once upon a time there was; a very hot passage, o say can you."
        rows.append((text, [None, "en", "fr", "en"][i % 4]))
    return rows + [(t, "en") for t in ODD]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"flush_grams": 300, "count_words": 250, "segment_bytes": 200, "bucket_words": 10}, {"fingerprint_bits": 7}, {"bitmap_bits": 16, "flush_grams": 1}])
def test_against_counting_all_phrases(spark, options, monkeypatch):
    if options:
        monkeypatch.setattr(co, "HELD_ROWS", 400)
    rows = corpus(1)
    want = brute(rows, 8)
    assert len(want) > 60 and {len(r[2].split(" ")) for r in want} == {2, 3, 4, 5}
    assert rows_of(co.collocations(made(spark, rows), min_count=8, **options)) == want


def test_clashing_fingerprints_within_a_part(spark):
    # 2**3 fingerprints for all n-grams: only their words tell them apart
    rows = corpus(2, docs=20, words=5)
    got = rows_of(co.collocations(made(spark, rows, 1), min_count=5, fingerprint_bits=3))
    assert got == brute(rows, 5)


@pytest.mark.parametrize("held_rows", [900, 5000])
def test_counts_combined_again_and_again(spark, held_rows):
    # a part's counts meet counts that were combined before; some are held, some handed on
    rows = corpus(6, docs=200)
    got = rows_of(co.collocations(made(spark, rows, 1), min_count=8, flush_grams=300, segment_bytes=200, held_rows=held_rows))
    assert got == brute(rows, 8)


def test_combining_in_steps_changes_nothing():
    rng = np.random.default_rng(5)
    fps = rng.integers(-1 << 63, (1 << 63) - 1, 50)
    parts = [[fps[at], fps[at] ^ 77, *rng.integers(1, 99, (3, 200))] for at in rng.integers(0, 50, (4, 200))]
    want = co._combine(parts)
    got = co._combine([co._combine([co._combine(parts[:2]), parts[2]]), parts[3]])
    assert len(want[0]) == 50 and all(a.dtype == b.dtype and (a == b).all() for a, b in zip(got[:4], want[:4]))


def test_top_and_percent(spark):
    rows = corpus(3)
    got = rows_of(co.collocations(made(spark, rows), min_count=6, percent=60, top=7, max_words=4))
    assert got == brute(rows, 6, 4, 60, 7) and max(r[1] for r in got) == 7


def test_scores_pass_64_bits(spark):
    # the products, not the text, are large: counts are given
    assert co.collocations(made(spark, [("a b. " * 120, "en")])).select("score").collect()[0][0] == 1000 * 120 * 240 // 120 ** 2


def test_hot_document_and_repeated_rows(spark):
    rows = [("same old story, again and again and again", "en")] * 300 + corpus(4, docs=20)
    assert rows_of(co.collocations(made(spark, rows, 6), min_count=20)) == brute(rows, 20)


def test_empty(spark):
    assert co.collocations(made(spark, [])).count() == 0
    assert co.collocations(made(spark, [(None, None), ("", "en")])).count() == 0


def test_cuts_end_where_a_piece_ends():
    data = np.frombuffer(("word " * 50 + ". " + "x" * 30 + ", y\n") .encode() * 20, np.uint8)
    parts = list(co.cuts(data, 100))
    assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert len(parts) > 10 and all(co._KIND[data[e - 1]] == 2 for _, e in parts[:-1])


def test_powers_have_inverses():
    up, down = co.FAMILIES[1].bytes(1000)
    assert (up[:1000] * down[:1000] == 1).all()
