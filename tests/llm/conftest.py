import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba de fi go hu ka le mi no pu ra se ti vo wa xe yo zu".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def make(spark, rows, extra=False):
    """documents from (doc_id, text, source); with columns whose names operators use themselves, if asked."""
    data = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    df = spark.createDataFrame(data, SCHEMA)
    if extra:
        for name in ("rid", "size", "h", "n", "score", "_row", "copies"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, repeats, a very long text."""
    return [(1, None, "a"), (2, "", None), (3, " \t\n ", "a"), (None, "one two", "b"), (5, prose(5, 40), "b"), (5, prose(5, 40), "b"), (7, prose(7, 30_000), "a"), (8, "word " * 200, None)]
