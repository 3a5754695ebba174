"""A small corpus with every case the operators define: nulls, empty and long texts, copies, near copies, shared passages, ties."""

from __future__ import annotations

import random


def documents(n: int = 120, seed: int = 7) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, sig) rows; sig clashes with a name that operators use."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, boiler = words(70), ["tick."] * 60
    texts: list[str | None] = [None, "", "  \n\t ", "one", "one", "a b c d", "A B c D", "x" * 3000, " ".join(words(9000))]
    base = words(150)
    while len(texts) < n:
        kind = len(texts) % 6
        if kind == 0:
            w = base[:]
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 1:
            w = words(rng.randint(0, 60)) + passage[rng.randint(0, 15) :] + words(rng.randint(0, 60))
        elif kind == 2:
            w = words(rng.randint(20, 80)) + boiler
        elif kind == 3:
            w = (rng.choice(texts[9:] or ["z"]) or "z").split()
        else:
            w = words(rng.randint(1, 200))
        texts.append("".join(x + rng.choice([" ", " ", "\n", "  "]) for x in w))
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]
    return rows + [(None, "a b c d", "en", None, 7, "x"), rows[20]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
