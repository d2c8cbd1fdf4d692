import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, rank int, key string"


def make(spark, rows):
    """A documents table with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 7, 1, "k") for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, long, empty, blank and missing texts, and missing columns."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(60)
    rows = []
    for i in range(60):
        w = words(rng.randint(1, 160))
        if i % 5 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        rows.append([i, " ".join(w)])
    for i in range(60, 75):
        rows.append([i, rows[i - 60][1]])  # exact copies
    base = words(200)
    for i in range(75, 90):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = "edited"
        rows.append([i, "\n".join([" ".join(w[:100]), " \t".join(w[100:])])])
    rows += [[90, ""], [91, None], [92, " \n\t "], [93, "a b c"], [94, "A  B\tC"], [95, "same " * 300], [96, " ".join(words(5000))], [97, "x"], [97, "x"], [98, "one id"], [98, "two texts"], [None, "no id"], [None, None]]
    return [(i, t, "en" if k % 3 else None, f"s{k % 4}" if k % 7 else None) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return make(spark, corpus).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])
