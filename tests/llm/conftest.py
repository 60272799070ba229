import pytest

from helpers import DOCUMENTS, FOLDER


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, equal rows, equal texts, one id twice, odd characters, a long text."""
    sentence = "The river runs past the old mill and on to the sea beyond the hills."
    text = "\n".join(f"{sentence} Line {i} says so." for i in range(12))
    rows = [
        (1, text, "en", "a", 1), (2, text, "en", "a", 1), (2, text, "en", "a", 1), (3, text + " End.", "en", None, 1),
        (4, None, "en", "b", None), (5, "", None, "b", 0), (6, " \n\t\x0b ", "en", "b", 5), (None, text, None, None, None),
        (None, "ein kurzer Satz", "de", "c", 3), (7, "a", "de", "c", 1), (8, "1234 5678", None, "c", 9),
        (9, "Übung macht den Meister über alle Maßen 😀 \x85 \xa0 x", "de", "c", 40), (9, "other text under the same id", "en", "c", 4),
        (10, "x" * 3000, None, "d", 3000), (11, " ".join(f"w{i % 977}" for i in range(30_000)), "en", "d", 1), (12, "\n".join(["same line here again"] * 9), "en", "d", 2),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
