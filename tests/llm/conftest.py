import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that operators use inside, as columns of the input.
CLASHING = ["size", "shard", "_row", "spans", "did", "th", "times", "key", "row", "tox", "fp", "at", "word", "q_lines"]

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "no id here, but words all the same.", "en", "b", 35),
    (None, None, None, "b", None),
    (4, LONG, "en", "b", len(LONG)),
    (5, "same text twice", "en", "c", 15),
    (5, "same text twice", "en", "c", 15),
    (6, "same text twice", "en", None, 15),
    (7, "été ▁ 　 漢字 😀 \x00 tab\tnew\nline\r\n", "fr", "c", 27),
    (8, " \t\n\x0b\x0c\r ", "en", "c", 7),
    (9, "x" * 1500, "en", "c", 1500),
]


@pytest.fixture()
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def folder(spark, tmp_path):
    """A function that writes tables and gives their folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, 0), (5, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
