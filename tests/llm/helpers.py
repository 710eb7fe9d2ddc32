"""A small corpus with every case that the operators must bear, and plain helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, gram long, hit int, _n int, score double"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(n=24, seed=3):
    """(doc_id, text): null, empty, blank, short, long, copied, nearly copied texts; shared passages; repeated rows."""
    rng = random.Random(seed)
    base, passage = sentence(rng, 120), sentence(rng, 60)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "One TWO"), (5, base), (6, base), (7, base + " tail"), (8, "\n".join(base.split(" "))), (9, "x " * 3000)]
    for i in range(10, n):
        text = sentence(rng, rng.randint(5, 200))
        if i % 3 == 0:
            text += " " + passage + " " + sentence(rng, 30)
        if i % 5 == 0:
            words = base.split(" ")
            words[rng.randint(0, 100)] = "changed"
            text = " ".join(words)
        rows.append((i, text))
    rows += [(n, base), (n, base), (None, base), (n + 1, passage + " 😀 é")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), "d", 1, 2, 3, 0.5) for i, t in rows], SCHEMA)


def words(text):
    return (text or "").encode().split()


def lower_words(text):
    return (text or "").encode().lower().split()
