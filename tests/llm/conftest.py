import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Null ids and texts, empty and blank texts, ties, repeated rows, a very long text.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old mill today."),
    (2, None),
    (None, "token = 'abcdefGHIJKL1234' and more"),
    (4, ""),
    (4, ""),
    (5, " \n\t "),
    (6, "The quick brown fox jumps over the lazy dog near the old mill today."),
    (6, "The quick brown fox jumps over the lazy dog near the old mill today."),
    (7, "a b c d e\na b c d e\na b c d e\néÉ 漢字 \U0001f600"),
    (8, "word " * 30_000 + "4111 1111 1111 1111 mail me@example.org"),
    (9, "x" * 50_000),
    (None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns named like helpers of the operators, and one of a type that can not be hashed.
CLASHING = (
    "row string, key string, cell int, part int, page int, words string, near int, hits int, size int, "
    "depth int, shard string, copy int, quality int, text_key int, salt int, n int, m map<string,int>"
)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The odd rows as ``documents`` with extra columns of clashing names."""
    rows = [(i, t, "en", None if i == 7 else "src0", None) for i, t in TEXTS]
    docs = spark.createDataFrame(rows, SCHEMA)
    extra = [c.strip().split(" ", 1) for c in CLASHING.split(", ")]
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in extra)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
