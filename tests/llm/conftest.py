import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, blank, very long, repeated rows and clashing extra columns."""
    long_text = "a very long text of many words " * 20_000
    rows = [
        (1, "plain words of a short text", "en", "a", 27, "x", 1.0, 5),
        (1, "plain words of a short text", "en", "a", 27, "x", 1.0, 5),
        (2, None, "en", None, None, None, None, None),
        (None, "a text without an id", None, "b", 20, "y", 2.0, 6),
        (None, None, None, None, None, None, None, None),
        (3, "", "fr", "b", 0, "z", 3.0, 7),
        (4, " \n\t ", "fr", "b", 4, "z", 3.0, 7),
        (5, long_text, "en", "a", len(long_text), "z", 3.0, 7),
        (6, "word", "de", "c", 4, "z", 3.0, 7),
        (7, "ünïcödé 文字 \U0001f600 text", "de", "c", 16, "z", 3.0, 7),
    ]
    return spark.createDataFrame(rows, DOCS + ", node string, probability double, position int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
