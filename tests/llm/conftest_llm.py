import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
LONG = " ".join(f"w{i % 997}x{i}" for i in range(40_000))
SHARED = " ".join(f"shared{i}" for i in range(40))


def docs_of(spark, rows):
    """Documents of (id, text, source) with columns whose names clash with results and helpers."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in ("i", "t", "c", "h", "k", "f", "n", "s", "b", "kept", "n_words", "spans", "kept_text", "row", "copies", "mix_copy", "_key"):
        df = df.withColumn(name, F.lit("clash"))
    return df


ODD = [
    (None, None, None), (None, "no id here", "a"), (1, None, "a"), (2, "", "a"), (3, " \t\n ", "b"), (4, "one", "b"),
    (5, "one two", "b"), (6, "A B c d e f", None), (6, "A B c d e f", None), (6, "another text with the same id", "b"),
    (7, LONG, "a"), (8, LONG + " tail", "a"), (9, "Ünïcode wörds   and 漢字 😀 <|im_end|>", "c"),
    (10, f"start {SHARED} end", "a"), (11, f"other {SHARED} words behind it", "c"), (12, "a a a a a a " * 30, "a"),
    (13, "line one\nline two\nline one\n\n", "c"), (14, "x" * 300_000, "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return docs_of(spark, [])
