import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary):x}{'q' * r.randrange(4)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, empties, nulls and a long one."""
    r = random.Random(5)
    texts = [" ".join(words(r, r.randrange(1, 120))) for _ in range(60)]
    passage = " ".join(words(r, 50))
    for i in range(0, 20, 2):
        texts[i] = texts[i] + "\n" + passage + " " + texts[i + 1]
    base = words(r, 100)
    for i in range(12):
        near = list(base)
        near[r.randrange(100)] = f"edit{i}"
        texts.append(" ".join(near))
    texts += [texts[3], texts[3], texts[4], passage, "", None, "   ", "Émile's  café\t\tc'est l'été  ", "short", "short", "!!!"]
    texts.append(" ".join(words(r, 5000)))
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(3 * i - 40, texts[j], ["en", "fr", None][j % 3], ["a", "b", None, "é", "c"][j % 5], 0) for i, j in enumerate(order)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Columns with names that operators use inside, null ids, repeated rows and ids."""
    rows = [(1, "a b c", "en", "s", 1, "x", 5), (1, "a b c", "en", "s", 1, "x", 5), (2, None, None, None, None, None, None), (None, "a b c", "en", "s", 1, "x", 5), (3, "", "en", "s", 1, "x", 5), (2, "d e f", "fr", "t", 1, "x", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, row string, h int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
