import random

import pytest

COLUMNS = "doc_id long, text string, source string, n long, row string, word string, size long, key string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Texts with null, empty, short and very long ones, exact and near copies, and mixed case."""
    rng = random.Random(5)
    out = [None, "", " \n\t", "One", "one two", "A b C d", None, "", "x" * 50_000]
    for _ in range(40):
        base = words(rng, rng.randrange(20, 120))
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            near = list(base)
            near[rng.randrange(len(near))] = "Changed"
            out.append("\n".join(near) if rng.random() < 0.5 else " ".join(near))
        if rng.random() < 0.4:
            out += [out[-1]] * 3
    out.append(" ".join(words(rng, 30_000, 5_000)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """A table with other columns whose names operators use inside, null sources and a repeated row."""
    rows = [(i, t, [None, "a", "b", "B", "é"][i % 5], 1, "r", "w", 2, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[10]], COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
