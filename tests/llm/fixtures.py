"""Awkward documents and pages that every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
        (2, "the quick brown fox jumps over the lazy dog again and again", None, None, None),
        (3, None, "en", "a", None),
        (4, "", None, "a", 0),
        (5, " \t\n", "fr", None, 3),
        (None, "rows without an id are rows too", None, None, None),
        (None, None, None, None, None),
        (6, "\x00 İ ퟿ 😀 é ς Σ", "xx", "b", 9),
        (7, "word " * 60_000, "en", "b", 300_000),
        (8, "x" * 200_000, "en", "b", 200_000),
        (-9, "!!! ### $$$ %%%", "en", "b", 15),
    ]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    """The same rows with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["node", "key", "set", "n", "len", "salt", "rank", "bands", "odd", "lang_pred", "score", "_base", "_spans", "at", "host", "n_words", "kept", "component"]
    return df.select("*", *(F.lit(7).alias(x) for x in names))


def empty(spark):
    return spark.createDataFrame([], DOCS)
