import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """Documents with exact and near copies, shared passages, separators of all kinds, empty, null, blank and long texts."""
    rng = random.Random(5)
    shared, other = prose(rng, 70), prose(rng, 55)
    rows = [prose(rng, rng.randint(1, 200)) for _ in range(30)]
    rows += [rows[3], rows[3], rows[7] + " end", "Start " + rows[8]]
    rows += [f"{prose(rng, 20)} {shared} {prose(rng, 10)}" for _ in range(6)]
    rows += [f"{prose(rng, 5)}\n{other}\t{prose(rng, 9)}\x0b{shared}" for _ in range(3)]
    rows += [f"{shared} {shared}", "", None, "   ", "\n", "x", "é漢字   ß\U0001f600 Ünï " * 30, prose(rng, 6000)]
    base = prose(rng, 150).split()
    for _ in range(12):  # near copies: one word of many changed
        copy = list(base)
        copy[rng.randrange(len(copy))] = "changed"
        rows.append(" ".join(copy))
    return [(3 * i + 2, x, None if i % 9 == 4 else "en" if i % 2 else "de", None if i % 10 == 3 else f"s{i % 4}", len(x or "")) for i, x in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, rows that share an id, null in every column, and extra columns whose names the operators use themselves."""
    rows = [(None, "a b c", None, None, None), (1, "w " * 80, "en", "s", 1), (1, "w " * 80, "en", "s", 1), (1, "other words here", "en", "s", 1), (2, None, None, None, None), (2, "w " * 80, "en", "s", 1), (None, None, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    from pyspark.sql import functions as F

    for name in ("m", "h", "doc", "at", "n", "lo", "hi", "size", "score", "lang_pred", "n_tokens", "part", "block", "kept", "component", "first", "ats", "target", "copies", "lower", "near", "far"):
        df = df.withColumn(name, F.lit("clash"))
    return df
