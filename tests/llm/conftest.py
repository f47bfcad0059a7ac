import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("fp", StringType()), StructField("key", LongType()), StructField("n", LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) pairs, with extra columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", 1, 2) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd white space and characters outside the basic plane."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(60_000))
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "One TWO three four five six seven"), (6, "One TWO three four five six seven"), (6, "One TWO three four five six seven"),
        (None, "null id with a few words in it"), (7, long), (8, "déjà vu   İstanbul ΣΑΣ ﬁne é \U0001f600 \x1c sep line \x85 end"), (9, "<|endoftext|> it's 1234 a<|startoftext|>b isn't"), (10, "x" * 5000), (11, "tie tie tie tie tie tie tie tie tie tie tie tie"),
    ]
