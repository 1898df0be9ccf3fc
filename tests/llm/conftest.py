"""Small tables for the operators of the llm subpackage."""

import pytest

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""
    def build(*rows):
        made = spark.createDataFrame([(i, t, "en", f"s{n % 3}" if n % 4 else None, len(t or "")) for n, (i, t) in enumerate(rows)], DOCS)
        return made.selectExpr("*", "'x' AS key", "1 AS id", "'y' AS items", "2 AS score", "3 AS place", "4 AS part", "5 AS arc")

    return build


ODD = [(1, None), (2, ""), (None, "no id here at all, but some words"), (3, "word " * 30_000), (4, "a b"), (4, "a b"),
       (5, "ÄÖ 한국어 ½ \u0000 \x1f <|endoftext|> x"), (6, " \n\t ")]
