import pytest

#: Rows that every operator has to take: nulls, empty and long texts, repeats, and extra columns with awkward names.
AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t", None, "b"), (4, "123 !!", "fr", "b"), (5, "same text here", "en", "a"), (5, "same text here", "en", "a"),
    (None, "null id here", None, None), (7, "long " * 30_000, "en", "c"), (8, "x" * 120_000, "en", "c"), (9, "é😀\u0000 ünï", "de", "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 as score", "'x' as text_in", "2 as size", "'y' as fp", "0 as th", "'q' as spans", "3 as id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
