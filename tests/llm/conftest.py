import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, chunk string, component_id long, kept string, rest int"


def corpus(seed: int = 0, n: int = 120) -> list[tuple]:
    """Random prose with exact and near copies, shared passages, repeated lines and edge cases.

    Extra columns have names that operators use inside.
    """
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(150)] + ["Été", "niño", "Straße"]
    sentence = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = sentence(60)
    texts = []
    for i in range(n):
        kind = r.random()
        if kind < 0.55 or len(texts) < 5:
            t = "\n".join(sentence(r.randint(1, 40)) for _ in range(r.randint(1, 4)))
        elif kind < 0.65:
            t = r.choice(texts)
        elif kind < 0.85:
            w = r.choice(texts).split(" ")
            for _ in range(max(1, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        else:
            t = sentence(10) + "\n" + passage + " " + sentence(8)
        texts.append(t if r.random() > 0.1 else t.upper())
    texts += [None, "", " \n\t ", "one", "one two", "one", "x" * 700, "ab " * 400, "\n\n\n", "12 34 !!", "ÀÉ"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s1", "s2", None]), None if t is None else len(t), 1, "c", None, "k", 7) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def texts():
    return {r[0]: r[1] for r in corpus()}


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and columns, and repeated rows."""
    rows = [(None, "a null id with a few words in it", None, None, None), (None, None, None, None, None), (5, "same row twice, word for word, again", "en", "s", 1), (5, "same row twice, word for word, again", "en", "s", 1), (6, None, None, None, None)]
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA)
