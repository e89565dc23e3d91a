import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in every column, empty and long texts, repeated rows, and extra
    columns with the names that operators give their own."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(None, "no id here at all", "en", "a"), (1, None, "en", "a"), (2, "", None, "b"), (3, "  \n\t ", "en", None),
            (4, "123 456 ... !!", "en", "a"), (5, long, "en", "b"), (6, "one two", "fr", "a"), (7, "one two", "fr", "a"),
            (8, "ONE two", None, None), (9, "the same row twice over and over again", "en", "b"),
            (9, "the same row twice over and over again", "en", "b"), (10, "é" * 30 + " ü.\nx", "de", "c"),
            (11, "a  b   c d \U0001F600 日本", "en", "c"), (12, "<|endoftext|> </s> [INST] x", "en", "c")]
    full = [(i, t, lang, s, None if t is None else len(t), 0.5, 7, "x", True, 3, "y", 0.1) for i, t, lang, s in rows]
    return spark.createDataFrame(full, COLUMNS + ", score double, part int, component_id string, kept boolean, "
                                           "_id long, _of string, _rate double")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
