import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, `table` string, chunk string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rng = random.Random(5)
    words = ["the", "of", "and", "über", "naïve", "日本", "zebra", "quick", "kiwi", "mark"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = "\n".join(line(12) for _ in range(3))
    long = "\n".join(line(9) for _ in range(3000))
    texts = [None, "", "", " \t\n ", "word", "word", "Word", shared, shared + "\nend of it", "start\n" + shared, long, long, long[:-40] + "changed", "x" * 500, "x" * 400, "ab" * 300, line(40), line(40) + "\r\n\x0b" + line(3), "é" * 120, "<|endoftext|> kiwi"]
    rows = [(i if i % 7 else None, t, None if i % 3 else "en", None, None, i, "t", "c") for i, t in enumerate(texts)]
    rows += [rows[8], (3, "another text of one id", "de", "s", 4, 1, None, None), (3, "and one more text of one id", "de", "s", 4, 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
