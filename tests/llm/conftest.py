import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, sig long, token string, start long"
WORDS = "the of and alpha beta gamma delta tion ander whold stern".split() + [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def nasty_rows():
    """Nulls, empty and long texts, ties, repeated rows, near and exact copies, odd white space."""
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    texts = [None, "", " \n\t ", "one", "one two", "a b c d", base, base, base.replace(" ", "\n"), base.upper(), prose(rng, 6000), "x" * 5000]
    for k in range(6):
        near = list(words)
        near[10 * k] = f"changed{k}"
        texts.append(" ".join(near))
    line = prose(rng, 14)
    texts += [f"{prose(rng, 20)}\n{line}\n{prose(rng, 15)}" for _ in range(6)]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or ""), 1, 2, "t", 3) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, "no id here at all " * 5, "en", "s1", 10, 1, 2, "t", 3))
    return rows


@pytest.fixture(scope="session")
def nasty(spark, nasty_rows):
    return spark.createDataFrame(nasty_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def plain(spark, nasty_rows):
    """The same without the repeated row and the row without id."""
    return spark.createDataFrame(nasty_rows[:-2], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
