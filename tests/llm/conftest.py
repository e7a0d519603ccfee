import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and extra columns with names used inside."""
    long_text = " ".join(f"word{k % 977} the of" for k in range(20_000))
    story = "the quick brown fox jumps over the lazy dog and runs away from the angry farmer near old mill\nsecond line of the story here"
    rows = [
        (1, story, "en", "a", 1, "x", True),
        (2, story, "en", "b", 1, "x", True),
        (2, story, "en", "b", 1, "x", True),
        (3, story.replace("angry", "sleepy"), "en", None, 1, None, None),
        (4, None, "en", "a", 0, "x", False),
        (5, "", None, "a", 0, "x", False),
        (6, "  \n\t ", "de", None, 0, "x", False),
        (None, "a text without an id but with some words in it", "en", "c", 2, "x", True),
        (7, long_text, "en", "a", 3, "x", True),
        (8, "Émile said « non » — it's fine 中文 😀 İstanbul", "fr", "b", 4, None, True),
        (9, "one two", "xx", "c", 5, "x", True),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words int, row string, kept boolean")


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("1 = 0")
