import pytest

from trackweave.session import local_session

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", "a", 4),
        (4, "one two three", "en", "a", 13),
        (5, "ONE two\nthree", "en", "b", 13),
        (6, "w " * 5000 + "end", "en", "b", 10003),
        (7, "x" * 40000, "en", None, 40000),
        (8, " ".join(f"t{i}" for i in range(300)), "en", "b", 0),
        (9, " ".join(f"t{i}" for i in range(300)), "en", "c", 0),
        (9, " ".join(f"t{i}" for i in range(300)), "en", "c", 0),
        (None, "no id here at all you see", "en", "c", 0),
        (10, "ünï çödé 日本語 🙂 text", "xx", "c", 0),
    ]
    df = spark.createDataFrame(rows, DOC)
    return df.selectExpr("*", "1 AS size", "'k' AS key", "2 AS word", "3 AS node", "0 AS uid", "9 AS label", "7 AS draw")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
