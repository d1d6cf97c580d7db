import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, spans int, size int"


def make(rows):
    """Rows with clashing extra columns."""
    return [(i, t, lang, s, None if t is None else len(t), "k", "s", 1, 2) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows, null ids."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 6)))
    base = [word() for _ in range(120)]
    passage = " ".join(word() for _ in range(60))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, "one two", "en", "a"),
            (5, "One  TWO", "en", "a"), (6, "a b c d e", "en", None), (7, "a b c d e f", "en", "a"), (None, "a b c d e", "fr", "b")]
    for i in range(10, 22):  # near copies
        w = list(base)
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(i, " ".join(base), "en", "a") for i in range(30, 36)]  # copies
    for i in range(40, 52):  # a shared passage
        rows.append((i, " ".join(word() for _ in range(25)) + " " + passage + "\n" + " ".join(word() for _ in range(30)), "en", "b"))
    rows.append((60, " ".join(word() for _ in range(6000)), "en", "b"))  # long
    rows.append((61, "x" * 30000, "en", "b"))
    rows.append((62, " ".join(["same"] * 200), "en", "b"))
    rows += [(70, passage, "en", "b"), (70, passage, "en", "b"), (71, None, "en", "b"), (71, None, "en", "b")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(make(odd_rows), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
