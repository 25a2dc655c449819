"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Words are runs of lower-case letters and digits. A text has a feature or not, however
often. Per-coordinate rates adapt to rare features and the L1 penalty leaves few
weights that are not 0, so that the model is a short list of numbers to broadcast.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._hashing import SIGNS, Texts, ngrams
from quillon.llm._labelled import TRAINING_CHARS, fold, trained, training_rows
from quillon.llm._workers import lean

HASH_BITS = 20
#: Words at i and at i + these: words, pairs, and pairs that skip one.
SHAPES = ((), (1,), (2,))
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 20.0, 0.0, 10
#: What an example of label 1 counts, since these are few.
POSITIVE = 5.0
#: Labelled documents that training takes at most.
TRAINING_ROWS = 20_000
_SLICE = 400_000


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of each n-gram and skip-gram, shape by shape."""
    cut = Texts([t.lower() for t in texts], SIGNS)
    words = cut.hashes()
    for gaps in SHAPES:
        h, doc = ngrams(words, cut.doc, gaps)
        yield (h >> np.uint64(64 - HASH_BITS)).astype(np.int64), doc


def examples(texts: list[str]) -> list[np.ndarray]:
    """The distinct buckets of each text, and at last the bias."""
    size, found = 1 << HASH_BITS, []
    for start in range(0, len(texts), 64):
        part = texts[start : start + 64]
        buckets, docs = map(np.concatenate, zip(*features(part)))
        keys = np.unique(docs * (size + 1) + buckets)
        docs, buckets = keys // (size + 1), keys % (size + 1)
        cuts = np.searchsorted(docs, np.arange(len(part) + 1))
        found += [np.append(buckets[a:b], size).astype(np.int32) for a, b in zip(cuts, cuts[1:])]
    return found


def ftrl(found: list[np.ndarray], y: list[int]) -> np.ndarray:
    """The weights that FTRL-proximal has after EPOCHS passes over the examples, the bias at last."""
    z, n = np.zeros((1 << HASH_BITS) + 1), np.zeros((1 << HASH_BITS) + 1)

    def weights(at):
        zs = z[at]
        w = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
        return w

    for _ in range(EPOCHS):
        for at, label in zip(found, y):
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            if label:
                g *= POSITIVE
            na = n[at]
            z[at] += g - (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA * w
            n[at] = na + g * g
    return weights(slice(None))


def fit(texts: list[str], y: list[int]) -> bytes:
    """The weights that are not 0: buckets, weights and bias."""
    size = 1 << HASH_BITS
    w = ftrl(examples(texts), y)
    kept = np.flatnonzero(w[:size])
    out = io.BytesIO()
    np.savez(out, buckets=kept.astype(np.int32), weights=w[kept].astype(np.float64), bias=w[size:])
    return out.getvalue()


def score(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1 of each text; table has a weight for each bucket."""
    found = []
    for buckets, docs in features(texts):
        hit = np.flatnonzero(table[buckets])
        found.append(docs[hit] << HASH_BITS | buckets[hit])
    keys = np.unique(np.concatenate(found))
    total = np.bincount(keys >> HASH_BITS, weights=table[keys & ((1 << HASH_BITS) - 1)], minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(total + bias, -35, 35)))


def load(model: bytes) -> tuple[np.ndarray, float]:
    with np.load(io.BytesIO(model)) as m:
        table = np.zeros(1 << HASH_BITS)
        table[m["buckets"]] = m["weights"]
        return table, float(m["bias"][0])


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAINING_ROWS, most_chars: int = TRAINING_CHARS) -> bytes:
    """A model from at most `most` labelled documents outside fold 0, of at most `most_chars` characters
    together: a text that does not fit beside those taken before it is left out alone.

    A null text is an empty one, ids and labels that are null take no part, a repeated row counts as often as it
    stands there, an id labelled twice has the larger label. Without labelled rows every score is 0.5.
    """
    return trained(training_rows(docs, labels, label, most), fit, most_chars)


def score_toxicity(docs: DataFrame, model: bytes, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    held_out: the id's crc32 modulo 5 is 0. A null or empty text has the bias alone as its
    score. Repeated rows are scored one by one; a null id stays null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scored(rows, model, load, score, threshold, "doc_id long, held_out boolean", ["doc_id", "held_out"])


def scored(rows: DataFrame, model: bytes, load, score, threshold: float, schema, names: list[str], text: str = "text") -> DataFrame:
    """rows' columns `names`, then score and predicted of their text (null: empty), by slices of bounded size.

    schema: of the columns `names`, as a string.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters = load(shared.value)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
            start = total = 0
            for i in range(len(texts) + 1):
                n = len(texts[i]) if i < len(texts) else 0
                if i > start and (i == len(texts) or total + n > _SLICE):
                    part = batch.slice(start, i - start)
                    p = score(texts[start:i], *parameters)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])
                    start, total = i, 0
                total += n

    return rows.mapInArrow(lean(run), f"{schema}, score double, predicted int")
