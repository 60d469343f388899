import random

import pytest

ODD = [
    (101, None, None, None, None), (102, "", "en", "a", 0), (103, "   \n\t ", "en", "a", 6), (104, "!!! ... 123", None, "a", 11), (105, "word " * 30_000, "en", "hot", 150_000),
    (106, "x" * 60_000, "en", "hot", 60_000), (107, "the same text twice over here", "en", "hot", 29), (107, "the same text twice over here", "en", "hot", 29), (None, "no id at all here", "en", "hot", 17),
    (108, "a\r\nb\u0085c\u2028d é ü 漢字 \U0001f600", "fr", "b", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """odd with columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ("row", "id", "score", "lang_pred", "kept", "n_words", "media", "n_bytes", "spans", "removed", "topic", "p", "weight", "key", "component", "items")
    return odd.withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): random lines, copies of documents with edits, shared lines and passages."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    shared = [[line(rng.randint(5, 20)) for _ in range(4)] for _ in range(3)]
    docs = []
    for i in range(120):
        lines = [line(rng.randint(1, 25)) for _ in range(rng.randint(0, 9))]
        if i % 5 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(shared)
        if i % 7 == 3 and docs:
            words = rng.choice(docs)[1].split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines = " ".join(words).split("\n")
        docs.append((i * 3 % 121, "\n".join(lines)))
    return docs
