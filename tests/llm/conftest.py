import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


WEIRD = "doc_id long, text string, lang string, slot int, n_lines string, component_id string, key string, score string, id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(20_000))
    rows = [
        (1, None), (2, ""), (3, "   \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "no id at all here"), (None, None),
        (6, long), (7, long), (8, "Ünïcode ß line\nsecond\n\nfourth"), (9, "a\n" * 50), (10, "x" * 120_000),
    ]
    return spark.createDataFrame([(i, t, None, 1, "a", "b", "c", None, "d") for i, t in rows], WEIRD)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
