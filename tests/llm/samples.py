"""Small tables with everything that real ones have."""

import random

WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta of the and to in".split()


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


LONG = sentence(7, 30_000)
# Null, empty and blank texts, ties, repeated rows, a null id, null sources, a very long text.
ODD = [
    (1, None, "b"),
    (2, "", None),
    (3, " \t\n", "a"),
    (4, "One  two\tthree", "a"),
    (5, "One two three", "a"),
    (5, "One two three", "a"),
    (6, sentence(1, 60), "b"),
    (7, sentence(1, 60), "b"),
    (8, sentence(1, 59) + " changed", "Ä"),
    (9, LONG, "b"),
    (None, "no id here", "a"),
    (11, "é ü 漢字 🙂 <|endoftext|>", "é"),
    (12, sentence(3, 40) + "\n\n" + sentence(4, 40), None),
]
# Columns whose names an operator might use itself.
CLASHING = "_row int, digest string, size string, word string, score string, _text int, shard int"


def odd(spark, rows=ODD):
    """``doc_id, text, source`` and columns with clashing names."""
    extra = (0, "d", "s", "w", "x", 1, 2)
    schema = f"doc_id long, text string, source string, lang string, n_chars long, {CLASHING}"
    full = [(i, t, s, "en", len(t or ""), *extra) for i, t, s in rows]
    return spark.createDataFrame(full, schema)


def empty(spark):
    return odd(spark, [])
