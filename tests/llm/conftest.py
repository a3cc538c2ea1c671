import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int, kept boolean, fp long, length long, word string"

LONG = "alpha beta gamma delta " * 6000


def row(i, text, source="s0"):
    return (i, text, "en", source, len(text or ""), 0.5, 7, True, 3, 9, "w")


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs, empty and very long texts, ties, repeated rows, clashing column names."""
    rows = [row(1, "The same text here, you see."), row(2, "The  same text\there, you see."), row(3, None), row(4, ""),
            row(5, " \n\t "), row(6, LONG), row(7, LONG + "x"), row(8, "one"), row(8, "one"), row(9, "ONE"),
            row(None, "no id at all"), row(10, "é ü ß 漢字 İstanbul Σας"), row(11, None, None),
            (12, "null columns", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
