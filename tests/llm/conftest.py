"""Small inputs that every text operator has to survive."""

import pytest

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 15_000 + "x" * 6_000

#: (doc_id, text, lang, source, n_chars): nulls everywhere, empty and long texts, repeated rows, ties.
ROWS = [
    (1, "The first document has a few plain words and ends here.\nSecond line.\n", "en", "a", 69),
    (2, "", "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, None, None, None, None),
    (None, "Ein Text ohne Nummer, aber mit Wörtern.", "de", None, 40),
    (4, LONG, "en", "b", len(LONG)),
    (4, LONG, "en", "b", len(LONG)),
    (5, " \t\n\v\f\r ", None, "b", 7),
    (6, "😀 é ß   \x1c naïve password = hunter2hunter2", "fr", "", -1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; they have to pass unharmed or be ignored.
CLASHES = ["fp", "spans", "score", "kept", "row", "digest", "_id", "_key", "_kept", "_own", "component_id", "ids", "k1", "word", "n_words"]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture
def odd_docs(spark):
    return with_clashes(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture
def no_docs(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
