import pytest

#: Nulls, an empty and a blank text, ties, repeated rows, columns whose names the operators use themselves.
ROWS = [
    (1, "a b c d e f g h i j", "en", "s1", 19, "x", "y", 1.5),
    (1, "a b c d e f g h i j", "en", "s1", 19, "x", "y", 1.5),
    (2, "a b c d e f g h i j", "en", None, 19, "x", "y", 1.5),
    (3, None, "en", "s1", None, "x", "y", 1.5),
    (4, "", None, "s2", 0, None, None, None),
    (5, " \n\t ", "de", "s2", 4, "x", "y", 1.5),
    (None, "text without an id 4041894974608795", "de", "s2", 35, "x", "y", 1.5),
    (6, "one", "fr", "s3", 3, "x", "y", 1.5),
    (7, "é" * 5 + " 日本語 🙂 " + "z" * 3000, "fr", "s3", 0, "x", "y", 1.5),
    (8, "long line of words " * 9000, "en", "s3", 0, "x", "y", 1.5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, bucket string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
