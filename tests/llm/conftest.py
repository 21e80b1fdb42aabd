import pytest

TEXTS = [
    (1, "The cat sat on the mat.", "en", "b"),
    (2, "the  cat\tsat on\nthe mat. ", "en", "b"),
    (3, "The cat sat on the mat.", "en", "a"),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \n\t ", None, "a"),
    (7, "1234 ... 5678 !?", "de", None),
    (8, "Der Hund läuft über die Straße und bellt.", "de", "c"),
    (9, "漢字かな交じり文と emoji 🙂 and <|endoftext|> inside", "en", "c"),
    (10, "word " * 3000, "en", "b"),
    (11, "x" * 5000, "en", "b"),
    (12, "a▁b c", "en", "b"),
    (12, "a▁b c", "en", "b"),
    (None, "The cat sat on the mat.", "en", "b"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, a repeated row, a null id, columns with clashing names."""
    rows = [(*r, "t", 1, "h", "k") for r in TEXTS]
    schema = "doc_id long, text string, lang string, source string, norm string, size int, head string, key string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
