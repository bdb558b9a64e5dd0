"""Small inputs with the cases that every operator must bear."""

import random

CLASHING = "doc_id long, text string, source string, lang string, n_chars int, k int, k2 string, t int, size int, score double, fp int, n int, doc string"


def documents(spark, rows):
    """A documents table of (doc_id, text[, source]) rows with further columns whose names operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "en", 0, None, "x", 7, 8, 0.5, 3, 2, None) for r in rows]
    return spark.createDataFrame(full, CLASHING)


def empty_documents(spark):
    return spark.createDataFrame([], CLASHING)


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Über", "zwölf", "e1", "x-y", "end."]) for _ in range(n))


def odd_rows(seed: int = 1):
    """Nulls, empty texts, repeated rows, repeated and missing ids, a long text."""
    rng = random.Random(seed)
    long = words(rng, 3000)
    return [
        (1, None, "a"), (2, "", None), (3, "  \n\t ", "a"), (4, words(rng, 60), "a"), (4, words(rng, 50), "b"), (5, long, "b"),
        (5, long, "b"), (None, long, "a"), (None, None, None), (6, long[:2000], None), (7, "é" * 300, "c"), (8, words(rng, 60), "c"),
    ]
