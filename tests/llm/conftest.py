import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) pairs, over several partitions."""

    def make(rows, extra=()):
        full = [(i, t, None, None, None if t is None else len(t)) for i, t in rows]
        frame = spark.createDataFrame(full, SCHEMA).repartition(3)
        from pyspark.sql import functions as F

        for name in extra:
            frame = frame.withColumn(name, F.lit("x"))
        return frame

    return make


ODD = [
    (5, "the cat sat on the mat and it's fine"),
    (6, "the cat sat on the mat and it's fine"),
    (7, None),
    (8, ""),
    (9, "   \n\t  "),
    (10, "été 日本語 😀 <|endoftext|> 123,456"),
    (11, "a" * 3000),
    (12, "word " * 4000),
    (None, "no id here"),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD, extra=("ids", "shard", "score", "position", "_part"))


@pytest.fixture(scope="session")
def no_docs(make_docs, spark):
    return spark.createDataFrame([], SCHEMA)
