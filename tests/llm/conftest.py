import random

import pytest

SCHEMA = "doc_id long, text string, key long, n long, comp string, word string"


def near(text, rng, share=0.03):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(99)}" for w in text.split(" "))


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages, ties, nulls, empty and long texts, multi-byte characters."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)] + ["Éa", "ñ", "the", "The", "of", "mañana", "日本"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = say(60), say(16)
    texts = [None, "", " \n\t ", "one", "one", "a b c", "A B  C", "a b c d", "x " * 300, "na " * 80 + "end"]
    for _ in range(30):
        texts.append(say(rng.randrange(1, 120)))
    base = say(100)
    texts += [base, base, base, base + " tail", *(near(base, rng) for _ in range(12))]
    texts += [say(20) + " " + passage + "\n" + say(15) for _ in range(5)]
    texts += [say(9) + "\n" + line + "\n" + say(30) for _ in range(6)]
    texts += [passage + " " + say(3) + " " + passage, say(5000) + " " + passage]
    texts += ["é" * 150 + say(2), "b" + "é" * 150, "z" * 450, base[:199], base[:200], base[:201]]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, 1, 2, "c", "w") for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
