import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


#: Names that the operators use inside; a table may have columns so called.
CLASHING = ["doc", "part", "copy", "rest", "size", "score", "taken", "label", "key", "sketch", "node", "root", "h", "n", "anchor", "edge", "place"]


@pytest.fixture
def documents(spark):
    """A table of documents with extra columns whose names clash."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        wide = [(*r, *["x"] * len(CLASHING)) for r in rows]
        return spark.createDataFrame(wide, schema + "".join(f", {c} string" for c in CLASHING))

    return make


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
