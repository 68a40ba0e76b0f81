import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns with names that the operators use themselves.
CLASH = ["score", "keep_id", "component_id", "fp", "name", "level", "size", "rank", "start", "block", "ids", "spans", "shard", "x", "u", "v", "node", "copies", "_1"]


def odd_rows():
    long = "word soup number nine " * 4000
    return [
        (0, "", "en", "a", 0),
        (1, None, "en", "a", None),
        (2, "one two three", None, None, 13),
        (3, "one two three", "en", "b", 13),
        (3, "one two three", "en", "b", 13),
        (3, "one two four", "en", "b", 12),
        (None, "one two three", "en", "b", 13),
        (None, None, None, None, None),
        (4, long, "en", "c", len(long)),
        (5, long, "en", "c", len(long)),
        (6, long + "x", "en", "c", len(long) + 1),
        (7, " \n\t ", "fr", "c", 4),
        (8, "é漢𝄞 x y \x1c z", "fr", "c", 12),
        (9, "One TWO three", "en", "a", 13),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), DOC_SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def plain(df, *columns):
    """Rows as tuples in a fixed order."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
