import pytest

from tests.conftest import SF_SMALL


@pytest.fixture(scope="session")
def small(spark):
    """documents of the small tables as [(doc_id, text)]."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]


#: Nulls in any column, empty and blank texts, ties and repeated rows, odd characters, special strings, a very long text.
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (4, "one two three"), (4, "One TWO three"), (None, "one two three"),
    (None, None), (5, "naïve     日本語 ́x \x00\x01 <|endoftext|> tail"), (6, "<|endoftext|>"), (7, "word " * 30_000),
    (8, "x" * 20_000), (9, "don't can't we'll  I'm   \n\n end "), (2**62, "\x0bvertical\x0cfeed"),
]


@pytest.fixture
def odd(spark):
    """The odd rows, with extra columns whose names clash with those of the operators."""
    rows = [(i, t, "x", 1, "k", b"b", 0.5, {"row": 1}) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, n int, token string, ids binary, score double, row map<string,int>")


@pytest.fixture
def nothing(odd):
    return odd.where("false")
