"""Small document tables for the operator tests."""

from sceneloom.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, langs=None):
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def scratch(spark):
    return Scratch(spark, "test")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
