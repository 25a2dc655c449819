"""Token counts: pieces are counted once per distinct pre-token and joined to each
document's pre-token frequencies, without any ids.

A BPE or unigram piece of a SentencePiece file never spans the boundary between a
non-blank and a blank, so a text's count is the sum over its pre-tokens, a run of
blanks and what follows it. The distinct pre-tokens of a slice of documents form the
small side of the join; the join is made in the task that holds the slice, so that
no row is shuffled, however many documents share a word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._tokens import Distinct, slices
from quillon.llm._workers import lean, once

_RUN = re.compile(" +[^ ]*")
_META = "▁"


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the one blank that the library itself
    puts before what it encodes."""
    if not text:
        return []
    if _META in text:  # the library keeps blanks under this sign
        text = text.replace(_META, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUN.findall(" " + text)]


def _spans_blanks(model) -> bool:
    return any(_META in model.id_to_piece(i).lstrip(_META) for i in range(model.get_piece_size()))


class PieceCounter:
    """Counts pieces of texts; one for each Python worker."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if _spans_blanks(self.model):
            raise ValueError("this model has pieces that span blanks; texts can't be cut at blanks")
        # an empty pre-token is the one blank before it: the library adds none to ""
        self.pieces = Distinct(lambda new: [len(ids) if w else 1 for w, ids in zip(new, self.model.encode(new, num_threads=1))])

    def count(self, texts: list[str]) -> list[int]:
        frequencies = [Counter(pre_tokens(t)) for t in texts]
        pieces = self.pieces(set().union(*frequencies))
        counts = [sum(n * pieces[w] for w, n in f.items()) for f in frequencies]
        self.pieces.trim()
        return counts


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    n_tokens is what the library's encode() gives for the whole text, without begin
    or end tokens; over_limit is n_tokens > limit. A null text counts as empty: 0
    bytes, 0 tokens. A null id stays null, repeated rows are counted one by one, other
    columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(("pieces", model_file), lambda: PieceCounter(model_file))
        for batch in batches:
            for part, texts in slices(batch):
                n = pa.array(counter.count(texts), pa.int64())
                size = pc.fill_null(pc.cast(pc.binary_length(part.column("text")), pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(lean(run, keeps=True), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
