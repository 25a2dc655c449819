"""Best-fit packing by minimum bin slack.

Documents become id sequences, sequences become pieces of at most `capacity` ids, and
only the histogram of piece lengths - at most `capacity` numbers, whatever the input -
reaches the driver. There each bin takes the longest length left and, by a subset-sum
dynamic program over a bitset, the fullest combination of the others; a combination is
used for as many bins as the histogram allows before the next program runs. Pieces find
their bin by their rank among pieces of their length, which is counted per partition
first, so that a common length is never ranked in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._shared import checkpointed
from quillon.llm._tokens import slices
from quillon.llm._workers import lean, once

END_ID = 1
#: Words and parts that a worker keeps at most.
WORDS_KEPT = 300_000
_BLANKS = str.maketrans("\t\n\r", "   ")
#: Words whose normalization and pre-tokens are plain: Latin letters (composed, with a lower case of one
#: letter), ASCII digits and ASCII signs but the apostrophe, which starts contractions.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_SIGNS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_SIGNS}]*")
_PLAIN_TEXT = re.compile(f"[{_LETTERS}0-9{_SIGNS} \\t\\n\\r]*")
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")


def _byte_alphabet() -> str:
    """The printable sign that byte-level BPE has for each byte: itself, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return "".join(chr(b if b in own else next(free)) for b in range(256))


class _Parts(dict):
    """Ids of the parts met, each distinct one worked out once by `work`."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work = work

    def __missing__(self, part: str) -> bytes:
        self[part] = ids = self.work(part)
        return ids


class WordTokenizer(dict):
    """Ids of whole texts from those of their blank-separated words, one tokenizer per worker; a text of plain words
    only is cut into their parts at once.

    A text may be cut at ASCII blanks because the file's normalizer and pre-tokenizer
    treat what stands on both sides of one apart; any other file is used on whole texts.
    Itself it maps the words met to their ids, each distinct one worked out once.
    """

    def __init__(self, file: str):
        super().__init__()
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(file, encoding="utf-8") as f:
            parts = json.load(f)
        kinds = re.findall(r'"type": "(\w+)"', json.dumps([parts["normalizer"], parts["pre_tokenizer"]]))
        self.by_word = kinds == ["Sequence", "NFC", "Replace", "Lowercase", "Sequence", "Split", "ByteLevel"] and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in parts["added_tokens"])
        self.specials = tuple(t["content"] for t in parts["added_tokens"])
        self.alphabet = _byte_alphabet()
        self.parts = _Parts(self._part)

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            ids = self.parts[word.lower()]
        elif _PLAIN.fullmatch(word) and not ("<" in word and any(s in word for s in self.specials)):
            ids = b"".join([self.parts[x] for x in _PARTS.findall(word.lower())])
        else:
            ids = self._whole(word)
        self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        known = [t.id for t in self.tokenizer.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet))]
        return pack(f"<{len(known)}I", *known)

    def _whole(self, text: str) -> bytes:
        known = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(known)}I", *known)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return [self._whole(t) for t in texts]
        if len(self) + len(self.parts) > WORDS_KEPT:
            self.clear()
            self.parts.clear()
        of, part = self.__getitem__, self.parts.__getitem__
        out = []
        for t in texts:
            if _PLAIN_TEXT.fullmatch(t) and not ("<" in t and any(s in t for s in self.specials)):
                out.append(b"".join(map(part, _PARTS.findall(t.lower()))))
            else:
                out.append(b"".join(map(of, (t.translate(_BLANKS) if "\t" in t or "\r" in t else t.replace("\n", " ")).split(" "))))
        return out


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row, and task and nth:
    the partition that made it and its place among that partition's pieces of its length.

    A document is its ids and END_ID. Only documents longer than capacity are cut. A null
    text is empty and thus one id long; repeated rows are packed one by one; a null id
    stays null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end, step = pack("<I", END_ID), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("words", tokenizer_file), lambda: WordTokenizer(tokenizer_file))
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for part, texts in slices(batch):
                columns: list[list[int]] = [[], [], [], [], [], []]
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        piece = ids[at : at + step]
                        length = len(piece) // 4
                        for column, value in zip(columns, (doc, k, at // 4, length, zlib.crc32(piece), seen[length])):
                            column.append(value)
                        seen[length] += 1
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([task] * n, pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return rows.mapInArrow(lean(run, keeps=True), "doc_id long, piece long, start long, length long, ids_crc32 long, nth long, task int")


def fullest(available: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The lengths, each with its number, whose sum is the largest that is at most room and that the
    available numbers of each length allow. Longer lengths are tried first."""
    mask, reached = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((n for n, c in available.items() if c and n <= room), reverse=True):
        left, take = min(available[length], room // length), 1
        while left:  # numbers of a length by binary parts
            take = min(take, left)
            new = (reached << (take * length)) & mask & ~reached
            if new:
                reached |= new
                steps.append((new, length, take))
            left -= take
            take *= 2
        if reached >> room & 1:
            break
    target = reached.bit_length() - 1
    found: dict[int, int] = {}
    for new, length, take in reversed(steps):
        if target and new >> target & 1:
            found[length] = found.get(length, 0) + take
            target -= take * length
    return sorted(found.items(), reverse=True)


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, lengths in each with their numbers) until no length is left."""
    left = {n: c for n, c in histogram.items() if c}
    bins = []
    while left:
        seed = max(left)
        left[seed] -= 1
        combination = dict(fullest(left, capacity - seed))
        left[seed] += 1
        combination[seed] = combination.get(seed, 0) + 1
        times = min(left[n] // k for n, k in combination.items())
        bins.append((times, sorted(combination.items(), reverse=True)))
        for n, k in combination.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return bins


def _places(bins: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, number per sequence, first offset), by length and rank."""
    sequence, ranks, rows = 0, {}, []
    for times, combination in bins:
        offset = 0
        for length, k in combination:
            first = ranks.get(length, 0)
            rows.append((length, first, sequence, k, offset))
            ranks[length] = first + times * k
            offset += k * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (as token_pieces gives them) with sequence_id and offset in place of task and nth.

    Every piece gets a place; the pieces of a sequence lie one after the other from 0.
    """
    pieces = checkpointed(pieces)  # task and nth must not change if a task runs again
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = per_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("task", "length", F.coalesce("base", F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(minimum_bin_slack(histogram, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (places[:, 0] << 48) + places[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = places[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece").cast(pa.int32()), batch.column("start"), batch.column("length"), batch.column("ids_crc32"), pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A null or empty text is one piece of END_ID alone; a null id stays null; repeated rows are packed one by one, and
    pieces of equal length are taken in any order. Other columns are not read. An empty table gives an empty result.
    """
    return pack_pieces(token_pieces(docs, tokenizer_file, capacity, id_col, text_col), capacity)
