import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text[, source[, lang]]) rows."""

    def make(rows, more=""):
        full = [(i, t, r[1] if len(r) > 1 else "en", r[0] if r else "a", len(t or "")) for i, t, *r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and white texts, copies, a repeated row, a null id, a very long text."""
    long_text = " ".join(f"w{i}" for i in range(60_000))
    return make_docs([
        (1, "One two three four five six", "a"), (2, "one TWO three four five six", "b"), (3, None, "a"), (4, "", None), (5, " \t\n ", "a"),
        (6, "ÄPFEL und Öl\u2003x", "b"), (7, "äpfel und öl\u2003x", "b"), (8, long_text, "a"), (8, long_text, "a"), (None, "one two three four five six", "c", None), (9, "x", "c"),
    ])


CLASHES = ["_id", "_text", "_digest", "_sha", "keep_id", "kept", "rule", "host", "fp", "size", "score", "path", "_mix", "rank", "mask", "length"]
CLASHES += ["_size", "_null", "_source", "_band", "_hash", "_words", "_plan", "_at", "_copies", "_copy", "_host", "_path", "_token", "_best", "_score", "_limit", "_row", "apart"]
CLASHES += ["_op3_first", "_op3_digest", "_op3_sha", "_op3_id", "_op10_gone", "_op10_id", "_slot_of_ids", "_bits_of_ids", "digest", "bands", "root", "node"]


@pytest.fixture(scope="session")
def clashing():
    """The table with extra columns named as operators name theirs."""
    from pyspark.sql import functions as F

    return lambda df, but=(): df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES if c not in but and c not in df.columns})


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
