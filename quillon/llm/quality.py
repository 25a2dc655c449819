"""Quality by supervised subword embeddings: hashed word and character n-gram vectors,
averaged over the document, into a softmax; trained by stochastic gradient descent.

Words are kept as they are, with case and signs. The softmax is linear in the average,
so scoring needs no vectors: each bucket's vector becomes one number, its part of the
difference of the two classes' logits, and a document's logit is the mean of those.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._hashing import Texts
from quillon.llm._labelled import TRAINING_CHARS, fold, trained, training_rows
from quillon.llm.toxicity import scored

HASH_BITS = 18
CHARS = (3, 4)
DIMENSIONS, EPOCHS, RATE, SEED = 8, 4, 1.0, 7
#: Labelled documents that training takes at most.
TRAINING_ROWS = 6_000


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of each word, each repetition of a word at once, and each character n-gram.

    A pair of equal words is one feature, whatever the word, with bucket 0 for itself.
    """
    cut = Texts(texts)
    words = cut.hashes()
    found = [(np.maximum(words >> np.uint64(64 - HASH_BITS), np.uint64(1)).astype(np.int32), cut.doc)]
    twice = np.flatnonzero((words[1:] == words[:-1]) & (cut.doc[1:] == cut.doc[:-1])) + 1
    found.append((np.zeros(len(twice), np.int32), cut.doc[twice]))
    for n in CHARS:
        h, doc = cut.char_ngrams(n)
        found.append((np.maximum(h >> np.uint32(32 - HASH_BITS), np.uint32(1)).astype(np.int32), doc))
    return found


def fit(texts: list[str], y: list[int]) -> bytes:
    """Each bucket's part of the logit, and the bias, after EPOCHS passes."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << HASH_BITS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(texts)), 0
    for _ in range(EPOCHS):
        for start in range(0, len(texts), 32):
            part = texts[start : start + 32]
            buckets, docs = map(np.concatenate, zip(*features(part)))
            keys, counts = np.unique(docs * (1 << HASH_BITS) + buckets, return_counts=True)
            cuts = np.searchsorted(keys, np.arange(len(part) + 1) << HASH_BITS)
            for label, a, b in zip(y[start : start + 32], cuts, cuts[1:]):
                done += 1
                if a == b:
                    continue
                at = keys[a:b] & ((1 << HASH_BITS) - 1)
                share = (counts[a:b] / counts[a:b].sum()).astype(np.float32)
                own = vectors[at]
                hidden = share @ own
                logits = out @ hidden + bias
                e = np.exp(logits - logits.max())
                g = (RATE * (1 - done / steps)) * ((np.arange(2) == label) - e / e.sum()).astype(np.float32)
                back = g @ out
                out += np.outer(g, hidden)
                bias += 0.1 * g
                vectors[at] = own + np.minimum(1.0, share * len(at))[:, None] * back
    file = io.BytesIO()
    np.savez(file, parts=vectors @ (out[1] - out[0]), bias=np.array([bias[1] - bias[0]], np.float64))
    return file.getvalue()


def load(model: bytes) -> tuple[np.ndarray, float]:
    with np.load(io.BytesIO(model)) as m:
        return m["parts"].astype(np.float32), float(m["bias"][0])


def score(texts: list[str], parts: np.ndarray, bias: float) -> np.ndarray:
    """The softmax's probability of label 1 of each text."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for buckets, docs in features(texts):
        total += np.bincount(docs, weights=parts[buckets], minlength=len(texts))
        n += np.bincount(docs, minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -35, 35)))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_ROWS, most_chars: int = TRAINING_CHARS) -> bytes:
    """A model from at most `most` labelled documents outside fold 0, of at most `most_chars` characters
    together: a text that does not fit beside those taken before it is left out alone.

    A null text is an empty one and teaches nothing, as one without words; ids and labels that are null take no part,
    a repeated row counts as often as it stands there, an id labelled twice has the larger label. Without labelled rows
    every text has nearly the same score, near 0.5.
    """
    return trained(training_rows(docs, labels, label, most), fit, most_chars)


def score_quality(docs: DataFrame, model: bytes, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    held_out: the id's crc32 modulo 5 is 0. A null text, or one without words, has the bias
    alone as its score. Repeated rows are scored one by one; a null id stays null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scored(rows, model, load, score, threshold, "doc_id long, held_out boolean", ["doc_id", "held_out"])


def with_quality(docs: DataFrame, model: bytes, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs with every column, and score and predicted beside them; columns of docs of these names are replaced.

    A null text stays null and is scored as an empty one, repeated rows are scored one by one; an empty table gives an
    empty result. Other columns, ids included, may hold anything.
    """
    plain = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return scored(plain, model, load, score, threshold, schema, plain.columns, text_col)
