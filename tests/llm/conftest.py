from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` rows, with extra
    columns whose names the operators use themselves."""

    def build(rows):
        full = [(*r, *["en", "s"][len(r) - 2 :])[:4] for r in rows]
        frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCS)
        return frame.selectExpr("*", "1 AS kept", "2 AS keep_id", "3 AS score", "4 AS piece", "5 AS block")

    return build
