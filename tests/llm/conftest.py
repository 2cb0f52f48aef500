import pytest

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "s", 7), (1, "alpha beta gamma delta epsilon", "en", "s", 7), (1, "another text of the same id here", "en", "s", 7), (2, "", "en", None, 7), (3, None, None, "s", 7),
        (None, "no id at all but some words", "de", "s", 7), (4, LONG, "en", "s", 7), (5, LONG, None, None, None), (6, " \t\n ", "en", "s", 7), (None, None, None, None, None),
    ]
    clashing = ("fp", "_row", "N_Words", "limit_symbols", "_lang", "component_id", "found", "items", "h", "start", "held_out")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kept int").repartition(3)
    return docs.selectExpr("*", *(f"'old' AS `{c}`" for c in clashing))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, kept int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
