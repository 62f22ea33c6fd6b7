"""Awkward documents for the operators of the training-data subpackage."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMOKE = "/root/testdata/sf0.001"

#: Beside id and text: columns named like those the operators make themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars int, node string, label long, kept boolean,"
    " bucket long, size long, `row` long, shard int, n long, collection long"
)


def prose(rng: random.Random, words: int, letters: str = "aeionrstlméü") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, empty, null, blank, tiny and very long texts."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(30, 160)) for _ in range(24)]
    shared = prose(rng, 60)
    near = base[0].split()
    near[17] = "changed"
    out = [
        *base,
        base[1],
        base[1],
        " ".join(near),
        f"{prose(rng, 20)}\n{shared}\n{prose(rng, 20)}",
        f"{prose(rng, 35)}\n{shared}",
        "\n".join([prose(rng, 12)] * 9),
        prose(rng, 40) + " " + "x" * 900 + "y" * 900,
        prose(rng, 9000),
        "é" * 400 + "ü" + "é" * 400,
        "",
        None,
        " \t\n ",
        "one",
        "two words",
        "a b c d e",
        "tail\n",
        "\n\n\n",
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[3]), (3, texts[3]), (3, texts[4]), (None, texts[5]), (None, None)]
    full = [(i, t, None, "s", len(t or ""), "x", 1, True, 2, 3, 4, 5, 6, 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
