"""Small documents with every hard case, and brute-force versions of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def documents(spark, texts, first=0, extra=()):
    """Rows with columns whose names clash with those that operators add; extra: (doc_id, text) rows as they are."""
    rows = [(first + i, t) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0.5, "k") for i, t in rows], SCHEMA)


def words(rng, n, size=60):
    return [f"w{rng.randrange(size)}é" if rng.random() < 0.1 else f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed=0, n=40):
    """Texts with copies, near copies, shared passages, repeated lines, an empty one, blanks and a long one."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randrange(1, 120), 5000)) for _ in range(n)]
    passage = " ".join(words(rng, 60, 5000))
    lines = "\n".join(" ".join(words(rng, 6, 5000)) for _ in range(4))
    for i in range(0, n, 5):
        w = texts[i].split(" ")
        w[len(w) // 2] = "changed"
        texts += [texts[i], " ".join(w), texts[i + 1] + " " + passage + " tail", lines + "\n" + texts[i + 2] + "\n" + lines]
    return [*texts, "", "  ", "\n\n\n\n", "a\tb\r\nc\x0bd\x0ce\xa0f", "x " * 3000, "日本語 テキスト " * 50, "y", "y"]


def hard(spark, seed=0, n=40):
    """corpus() and rows with null ids, null texts and a repeated row."""
    texts = corpus(seed, n)
    return documents(spark, texts, extra=[(None, "no id here at all"), (None, None), (len(texts), None), (3, texts[3])])


def rows_of(df, id_col="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=str)
