import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, bucket string, TEXT_HASH long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, copies, ties, repeated rows and ids, and columns whose names clash."""
    rng = random.Random(5)
    words = ["alpha", "beta", "the", "of", "Gamma", "été", "x1", "|", "###", "mit", "license"]
    long = " ".join(rng.choice(words) for _ in range(9000))
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, long), (5, "The MIT License.\nSame line\nother"), (5, "The MIT License.\nSame line\nother"),
            (5, "another text of the same id"), (None, "no id at all\nSame line"), (7, "a" * 40_000), (8, "中文 текст 😀 ​\x1c end")]
    rows += [(100 + i, f"Same line\nown line number {i}\n  SAME LINE \n") for i in range(14)]
    return spark.createDataFrame([(i, t, None, "s", None, "clash", "clash", 7) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
