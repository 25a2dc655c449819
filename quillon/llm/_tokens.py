"""What the three tokenizer operators share: caches of distinct pre-tokens, and
batches of documents cut to a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Entries that a cache keeps at most, and characters of a pre-token worth keeping.
CACHE_ENTRIES = 1_000_000
CACHE_CHARS = 48
#: Documents are worked on in slices of about so many characters.
SLICE_CHARS = 2_000_000


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in slices of about SLICE_CHARS, with their texts (null: empty)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > SLICE_CHARS:
            part = batch.slice(start, i - start)
            yield part, ["" if t is None else t for t in part.column(text).to_pylist()]
            start, total = i, 0
        total += n
    if start < len(sizes):
        part = batch.slice(start)
        yield part, ["" if t is None else t for t in part.column(text).to_pylist()]


class Distinct:
    """Maps pre-tokens to what `work` makes of them, each distinct one worked on
    once while it is kept; `work` takes a list and returns one of equal length."""

    def __init__(self, work: Callable[[list[str]], list]):
        self.work = work
        self.kept: dict[str, object] = {}

    def __call__(self, words: set[str]) -> dict[str, object]:
        new = sorted(words.difference(self.kept))
        if new:
            if len(self.kept) + len(new) > CACHE_ENTRIES:
                self.kept = {w: self.kept[w] for w in words if w in self.kept}
                if len(self.kept) > CACHE_ENTRIES // 2:
                    self.kept = {}
                    new = sorted(words)
            self.kept.update(zip(new, self.work(new)))
        return self.kept

    def trim(self) -> None:
        """Drops what is too long, or too much, to keep past a slice."""
        if len(self.kept) > CACHE_ENTRIES:
            self.kept = {}
            return
        for w in [w for w in self.kept if len(w) > CACHE_CHARS]:
            del self.kept[w]
