"""The documents fixture of these tests (a module of its own: the folder above has the conftest)."""

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows, with columns that invite clashes."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for name in ("key", "_key", "size", "score", "words", "label", "_copy", "id", "n_hit", "row", "kept"):
                df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make
