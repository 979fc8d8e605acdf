"""Small tables of odd texts that the tests of the text operators share."""

import random
import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, node long, sigs string, key string"


def corpus(seed=3, n=60):
    """Texts with copies, near copies, a shared passage, junk, and odd rows; further columns clash with inner names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)).capitalize() + "."
    passage = text(60)
    out = []
    for i in range(n):
        body = "\n".join(text(rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))
        if i % 6 == 5:
            words = out[i - 1][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            body = " ".join(words) if i % 12 == 5 else out[i - 1][1]
        if i % 9 == 0:
            body += "\n" + passage
        out.append((i, body))
    out += [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "One"), (n + 4, text(3)), (n + 5, " \t\n "), (n + 6, "word " * 3000), (n + 7, "x" * 20000), (n + 8, "é日本 🎉\u2581a  b"), (n + 9, "\n".join(["same line here"] * 40))]
    return [(i, t, "en" if i % 3 else None, 1, "s", "k") for i, t in out]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
