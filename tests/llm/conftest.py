import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators might use themselves.
CLASH = (
    "blob string, spans string, rules string, words int, windows int, template int, size long, digest string, node long, "
    "band int, bucket long, label long, score double, hash long, prefix long, depth int, shard string, ids string, features int"
)


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) pairs; ``clash`` adds columns of awkward names."""

    def make(rows, clash=False):
        full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for c in CLASH.split(", "):
                name, kind = c.split()
                df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
        return df

    return make
