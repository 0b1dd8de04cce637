import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, norm string, text_sha256 string, salt int, label long, _id long, _mark long, "
          "_leaky long, _gone string, hash long, w string, score double, row long, form long, class long, n long, rank long, line string")
LONG = 60_000       # words of the very long text


def text_of(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(1 + rng.randrange(vocabulary) % 7)) for _ in range(words))


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with many columns of names that operators use inside; rows are (doc_id, text) or (doc_id, text, n_chars)."""
    def make(rows):
        wide = [(r[0], r[1], None, "s", r[2] if len(r) > 2 else (None if r[1] is None else len(r[1])), "x", "x", 1, 1, 1, 1, 1, "x", 1, "x", 0.5, 1, 1, 1, 1, 1, "x") for r in rows]
        return spark.createDataFrame(wide, SCHEMA).repartition(3)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, one id with two texts, a very long text, ties."""
    base = text_of(1, 80)
    return [(1, None), (2, ""), (3, " \n\t "), (4, base), (4, base), (5, base + " "), (None, base), (None, None), (6, "one two"),
            (7, text_of(2, 50)), (7, text_of(3, 50)), (8, text_of(4, LONG)), (9, base.replace(" ", "\n", 5)), (-3, base.upper()),
            (10, "call +1 (988) 555-2485 or jane@mail.example.com\npassword=abcdef123"), (11, "é" * 40 + " 10.1.2.3 ü")]
