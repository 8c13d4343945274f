import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, score double, kinds string, h1 long, part int"
LONG = "word " * 30_000 + "x" * 40_000 + " é" * 2_000


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, repeated ids."""
    texts = [None, "", "  \n", "one", "one", "A short text, of a few words.", "a short text, of a few words.", LONG, LONG, "\x00\x01 <|endoftext|> ' 's", "ёлка 北京 😀 été"]
    rows = [(i, t, "en", f"s{i % 3}", 0 if t is None else len(t), "k", 1, 0.5, "z", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, "another text of the same id", None, None, None, None, None, None, None, None, None)]
    return rows + [(None, "no id", None, None, None, None, None, None, None, None, None), (None,) * 11]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
