import hashlib
from collections import Counter

import corpus_pipeline
from semdex.llm import mixing, near_join, packing, quality
from semdex.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against its own input: what it keeps follows from its operator's rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["quality_classifier", "exact_dedup", "near_join", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF))
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_classifier":
            weights = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            good = {r.doc_id for r in quality.score(docs, weights).where("score >= 0.3").collect()}
            assert set(ids) == good
        if name == "exact_dedup":
            best = {}
            for i, t in before.items():
                h = hashlib.sha256((t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))).digest()
                best[h] = max(i, best.get(h, i))
            assert set(ids) == set(best.values()) and max(ids.values()) == 1
        if name == "near_join":
            found = near_join.near_join(docs, words=5, percent=80).collect()
            assert set(ids) == {r.component_id for r in found} and max(ids.values()) == 1
        if name == "mixing":
            taken = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect() if r.copies}
            assert ids == Counter(taken)
        if name != "packing":
            assert out.columns == columns
        else:
            assert out.groupBy().sum("length").first()[0] == sum(
                len(ids) // 4 + 1 for ids in packing.DocumentIds(packing.tokenizer_path()).every([r.text for r in docs.collect()]))
            assert set(ids) == set(before)
        docs = out
