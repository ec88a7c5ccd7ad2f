import pytest

# names that the operators use inside, to show that clashes do no harm
CLASHING = ["norm", "salt", "h", "row", "keep_id", "first", "size", "token", "cid", "score", "slot", "n", "p", "key",
            "bucket", "copies", "mix_id", "group", "y", "at", "text_hash", "component_id", "kept", "taken", "window"]


@pytest.fixture
def documents(spark):
    """rows (doc_id, text, source) -> documents with columns of clashing names."""
    def make(rows):
        rows = [(*r, "src0")[:3] for r in rows]
        schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(*r, *CLASHING) for r in rows], schema)
    return make


# nulls, empty and blank, ties, repeated rows, a very long text, non-ASCII, a lone surrogate-free emoji
ODD = [(1, "The Quick brown fox jumps"), (2, "the quick BROWN fox jumps"), (2, "the quick BROWN fox jumps"),
       (3, None), (4, ""), (5, " \t\n"), (None, "Élan vital 😀 déjà vu"), (None, None), (6, "élan vital 😀 déjà vu"),
       (7, "lorem ipsum dolor sit amet " * 60_000), (8, "x"), (9, "a\0b  c\r\nd\x0be"), (10, "Iİ K k K")]
