import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables are not here")
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    """The rows of the given table as a table of their own: caching the given one would change the plans of other tests."""
    return spark.createDataFrame(spark.read.parquet(f"{folder}/documents.parquet").toArrow()).cache()


LONG = "one two three four five six seven eight nine ten. " * 3000

ODD = [
    (None, "a row without an id but with some words in it, enough of them for a shingle", "en"),
    (1, None, "en"),
    (2, "", None),
    (3, " \n\t ", "fr"),
    (4, "12 34 !!", "en"),
    (5, LONG, "en"),
    (5, LONG, "en"),
    (6, "the same text for two documents with more than five words in it", "en"),
    (7, "the same text for two documents with more than five words in it", "de"),
    (8, "x" * 20000, None),
    (9, "日本語 text with émile's  odd   spacing\x1c and　more <|endoftext|> of it", "ja"),
    (9, "an id that two rows with other texts share, and this is one of them", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and extra columns whose names the operators use themselves."""
    rows = [(i, t, lang, 1, "x", 2.0, [3], True, 0) for i, t, lang in ODD]
    schema = (
        "doc_id long, text string, lang string, node int, verdict string, score double, bands array<int>, kept boolean, "
        "part int"
    )
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, node int")
