import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as columns of the input they must not matter.
CLASHING = "__row string, key string, rep string, component string, n string, uid string, score string, leaks string, window string"


@pytest.fixture
def make_docs(spark):
    """Rows (doc_id, text[, lang[, source]]) as documents with further, clashing columns."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        extra = ("x",) * 9
        return spark.createDataFrame([r + extra for r in full], f"{SCHEMA}, {CLASHING}")

    return make


@pytest.fixture
def words():
    """Reproducible invented sentences: words(n, seed, language) gives n words."""
    parts = {"en": "th er on an re he in ed nd ha at", "es": "que ción os as do ra ta ñe ll ez ar", "de": "sch ung keit ver ge ein ß ü ach heit be"}

    def make(n, seed, lang="en"):
        rng, own = random.Random(seed), parts[lang].split()
        return " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make


EDGE = [(None, None), (None, "null id"), (1, None), (2, ""), (3, "   \n "), (4, "one"), (4, "one"), (5, "one"), (6, "x" * 200_000), (7, "wort " * 30_000)]


@pytest.fixture
def edge_rows():
    return list(EDGE)
