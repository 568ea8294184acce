"""A small corpus with the awkward rows that every operator must take."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, bucket string, digest string"


def corpus(n: int = 60, seed: int = 3) -> list[tuple]:
    """n prose rows with copies, then null, empty, blank, one-word and very long texts and repeated rows."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "tion", "éa", "straße", "and,", "inger", "ñol", "wh", "re.", "ed", "ly"] + [f"w{i}" for i in range(200)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 7):
        texts[i] = texts[r.randrange(n)]
    for i in range(3, n, 9):
        texts[i] = texts[i][: len(texts[i]) // 2] + " " + " ".join(texts[0].split()[:40])
    texts += [None, "", " \n\t ", "one", "One", "the\u00a0of", "the  of", "x " * 30000, "y" * 70000, "the of", "the of"]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), i, "b", None) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[len(texts) - 1]]


def docs(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCS)
