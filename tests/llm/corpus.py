"""Small tables for the text operators: nulls, empty and long texts, repeated rows, clashing columns."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "n_words string, kept string, id int, row string, key string, block int, word string, `a.b` string"
)
WORDS = [a + b for a in ("the", "an", "tion", "er", "re", "on", "ti", "in", "es", "Ou") for b in ("", "th", "or", "nd.", "le,")]


def text_of(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + str(rng.randrange(40)))
        out.append("\n" if rng.random() < 0.05 else rng.choice([" ", "  ", "\t"]))
    return "".join(out)


def rows_of(n=120, seed=3):
    """(doc_id, text, lang, source): random texts, copies, edited copies, shared passages and odd cases."""
    rng = random.Random(seed)
    texts = [text_of(rng, rng.randrange(1, 120)) for _ in range(n)]
    passage = text_of(rng, 30)
    for i in range(0, n, 7):
        texts[i] = texts[i] + " " + passage
    for i in range(5, n, 9):
        texts[i] = texts[i - 1]
    for i in range(8, n, 10):
        words = texts[i - 2].split(" ")
        words[len(words) // 2] = "changed"
        texts[i] = " ".join(words)
    for i in range(0, n, 3):
        texts[i] += "\n  Shared LINE of all \n"
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 2}") for i, t in enumerate(texts)]
    rows += [
        (n, None, "en", "src0"),
        (n + 1, "", "en", None),
        (n + 2, " \t\n ", None, "src1"),
        (n + 3, "one", "en", "src0"),
        (n + 4, "one", "en", "src0"),
        (n + 5, "é  x y " * 9, "fr", "src1"),
        (n + 6, text_of(rng, 6000), "en", "src0"),
        (3, texts[3 % n], "en", "src0"),  # a repeated row
        (3, texts[3 % n], "en", "src0"),
        (4, text_of(rng, 40), "en", "src0"),  # a repeated doc_id
        (None, texts[10 % n], "en", "src0"),
        (None, "Shared line OF all\nx", "en", "src0"),
        (-7, texts[20 % n], "en", "src9"),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", 1, "z", "k", 2, "w", "q") for r in rows], SCHEMA)


def words(text, lower=False):
    data = (text or "").encode()
    return [w.decode() for w in (data.lower() if lower else data).split()]
