from __future__ import annotations

import pytest

#: Rows with nulls in any column, empty, letterless and short texts, a repeated row, a repeated id, and columns with clashing names.
ROWS = [
    (1, None, "en", "s", 0), (2, "", None, None, 0), (3, "12 34 !!", "en", "", 8), (4, "the cat sat on the mat and the dog", "en", "s", 35), (4, "the cat sat on the mat and the dog", "en", "s", 35),
    (5, "le chat est sur la table et le chien", "fr", "t", 36), (None, "word", "de", "t", 4), (5, "another text of the same id entirely", "en", None, 36), (6, "x " * 5000, "en", "s", 10000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    extra = ["base", "spans", "weak", "set_key", "row_key", "kept", "bucket", "key", "shard", "size", "ids", "media", "score", "passes", "cut", "weight"]
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
