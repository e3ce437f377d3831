import pytest

DOCS = "doc_id long, text string, extra string"
HARD = [
    (1, "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen.", "x"),
    (1, "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen.", "x"),
    (2, "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen.", None),
    (None, "a b c", "x"), (None, None, None), (3, None, "x"), (4, "", "x"), (5, " \n\t ", "x"), (6, "1234 5678 !!! ###", "x"), (7, "a" * 3000, "x"), (8, "word " * 5000, "x"), (9, "é à ü 漢字 \U0001f600 <|endoftext|>", "x"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows, and a further column."""
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def rows():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
