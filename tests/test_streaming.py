"""Query files streamed through the search equal the batch search."""

import os
import tempfile

from conftest import SF001
from semdex.plans.context import Inputs
from semdex.plans.search import search
from semdex.streaming.query_stream import start_query_stream


def test_stream_equals_batch(spark):
    ctx = Inputs(spark, SF001)
    d = tempfile.mkdtemp(prefix="semdex-stream-")
    src, out, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    ctx.queries.write.parquet(src)
    q = start_query_stream(spark, src, out, ck, ctx.word_vectors, ctx.dim, ctx.tables, "table_id", top=10)
    q.awaitTermination(600)
    got = sorted((r["query_id"], r["rank"], r["table_id"]) for r in spark.read.parquet(out).collect())
    batch, _ = search(ctx.queries, ctx.word_vectors, ctx.dim, ctx.tables, "table_id", learn=False, top=10)
    want = sorted((r["query_id"], r["rank"], r["table_id"]) for r in batch.collect())
    assert got == want and got
