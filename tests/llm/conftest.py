import pytest


@pytest.fixture()
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, and columns whose names the operators use themselves."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "   \n\t", None, "a", 5), (4, "one two three four five six", "en", "a", 27), (4, "one two three four five six", "en", "a", 27),
        (5, "One TWO three four five six", "en", "b", 27), (6, "ünïcödé 🙂 wörds and more of them here", "de", "b", None), (None, "a row without an id in it", "en", "b", 1),
        (7, "long " * 30_000 + "end", "en", "b", 1), (8, "x", "fr", "c", 1), (9, "12345 !!! 678", "fr", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: "z" for c in ("_id", "_text", "id", "key", "spans", "version", "n_words", "kept", "score", "h", "doc", "component_id", "bucket", "a", "b")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in clash.items()})


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
