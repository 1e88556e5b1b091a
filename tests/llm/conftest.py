import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400, stem="w"):
    return " ".join(f"{stem}{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=7):
    """Documents with copies, near copies, shared passages, nulls, empty, blank and very long texts, repeated rows and ids."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 60, stem="p")
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(25)]
    texts += [base] * 6 + [base + " " + prose(rng, 4) for _ in range(5)] + [prose(rng, 20) + " " + passage + "\n" + prose(rng, 30) for _ in range(6)]
    for _ in range(8):  # near copies with some words changed
        words = base.split()
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(words))
    texts += [None, "", " \t\n\v\f\r ", "one", "One", "a b c d", "A\tb\n c  d", "a b c d e", passage.upper(), "é\u00a0ü word", prose(rng, 6000), passage + " " + passage]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[3], rows[3], (rows[5][0], prose(rng, 70), None, None, 1), (None, base, "en", "s", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
