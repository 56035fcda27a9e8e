import pytest
from pyspark.sql import functions as F, types as T

SF_DIR = "/root/testdata/sf0.001"

#: What operators must bear: nulls, empty and long texts, copies, repeated rows, extra columns with names they use.
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8),
    (3, None),
    (4, ""),
    (5, " \t\r\n\x0b\x0c"),
    (6, "one two"),
    (7, "ONE  two"),
    (None, "Alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8),
    (None, None),
    (8, " ".join(f"word{i % 9973}" for i in range(60_000))),
    (9, "x" * 300_000),
    (10, "äöü 中文 \U0001f600 é ~ a~b \x00 \x1c ' <|endoftext|>"),
]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def frame(spark, rows=TEXTS):
    full = [(i, t, "en" if k % 2 else None, "a" if k % 3 else None, len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def edges(spark):
    """The odd rows, with extra columns whose names operators use themselves."""
    names = ("row", "score", "kept", "n_bytes", "removed", "size", "copies", "label", "list", "chunk", "html")
    return frame(spark).select("*", *[F.lit(f"own {n}").alias(n) for n in names])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
