import pytest

FOLDER = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names clash."""
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "a", 30, 1, "x", 0.5),
        (1, "alpha beta gamma delta epsilon", "en", "a", 30, 1, "x", 0.5),
        (2, "ALPHA  beta\tgamma delta\nepsilon", None, None, None, None, None, None),
        (3, None, "de", "b", 0, 2, "y", 1.0),
        (4, "", "de", "b", 0, 2, "y", 1.0),
        (5, " \n\t ", "fr", "c", 4, 3, "z", 2.0),
        (None, "alpha beta gamma delta epsilon", "en", "d", 30, 4, "x", 0.1),
        (6, LONG, "en", "a", len(LONG), 5, "x", 0.2),
        (7, LONG, "en", "b", len(LONG), 6, "x", 0.2),
        (8, "Éß 💥 <s> <|endoftext|> ▁ \x00", "xx", "e", 9, 7, "w", 0.3),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long, fingerprint string, "
        "score double").selectExpr("*", "doc_id AS node", "text AS word", "lang AS row", "source AS key", "n_chars AS hits",
                                   "1 AS f0", "2 AS same", "'q' AS content", "3 AS n_tokens", "array(1L) AS item_ids")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
