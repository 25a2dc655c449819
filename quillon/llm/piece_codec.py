"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct marked words of a slice of documents are sorted, which is a depth-first
walk of their trie: a word keeps the forward table of the prefix it shares with the
word before it and only extends it by its own last characters.

The forward table of a unigram file is Viterbi's: the best score of each prefix and
the piece that ends it. A BPE file has no such scores - its ids come from merges, and
the best sum of scores is another segmentation - so its table holds, for each prefix,
the one piece that ends the prefix's BPE encoding. That piece is the one whose left
neighbour, the last piece of the prefix before it, stays apart from it when the two
are encoded alone; so the same walk gives the library's ids for either kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._tokens import Distinct, slices
from quillon.llm._workers import lean, once
from quillon.llm.token_counts import _META, _spans_blanks, pre_tokens

#: What an unknown character costs a unigram path below the lowest score.
UNKNOWN_PENALTY = 10.0
PAIRS_KEPT = 1_000_000


def _is_unigram(model_file: str) -> bool:
    """Reads trainer_spec.model_type (field 2, then 3) of the model's protocol buffer: 1 is unigram, 2 BPE."""

    def fields(buf: bytes) -> Iterator[tuple[int, object]]:
        at = 0

        def varint() -> int:
            nonlocal at
            shift = value = 0
            while True:
                byte = buf[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(buf):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            elif kind == 2:
                n = varint()
                yield tag >> 3, buf[at : at + n]
                at += n
            else:
                n = 8 if kind == 1 else 4
                yield tag >> 3, buf[at : at + n]
                at += n

    with open(model_file, "rb") as f:
        trainer = next((v for k, v in fields(f.read()) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1) == 1


class PieceCodec:
    """Encodes and decodes with the pieces of a SentencePiece file; one per worker."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if _spans_blanks(model):
            raise ValueError("this model has pieces that span blanks; texts can't be cut at blanks")
        n = model.get_piece_size()
        self.unknown = model.unk_id()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [self.unknown] * 256
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.bytes_of.append(b"")
            elif model.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                self.bytes_of.append(piece.replace(_META, " ").encode())
        self.unigram = _is_unigram(model_file)
        #: Lengths, longest first, of the pieces that end in these two characters.
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                lengths.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {tail: tuple(sorted(n, reverse=True)) for tail, n in lengths.items()}
        self.floor = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.apart: dict[str, bool] = {}
        self.words = Distinct(self._walk)
        self.has_bytes = self.byte_ids[0] != self.unknown

    # -- one word's last pieces -------------------------------------------------

    def _merged(self, text: str) -> list[str]:
        """Plain BPE of a short text: the adjacent pair of best score merges first, the left one of equals."""
        parts, score = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, left: str, right: str, key: str) -> bool:
        if len(self.apart) >= PAIRS_KEPT:
            self.apart.clear()
        known = self.apart[key] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def _walk(self, words: list[str]) -> list[bytes]:
        """The ids of each of the sorted words, as bytes of little-endian 32-bit numbers."""
        out: list[bytes] = []
        unigram, ids, scores, lengths, apart = self.unigram, self.ids, self.scores, self.lengths, self.apart
        before = ""
        last: list[str] = [""]
        best: list[float] = [0.0]
        for raw in words:
            word = _META + raw.replace(" ", _META)
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                piece = word[i - 1]
                if unigram:
                    top = best[i - 1] + scores.get(piece, self.floor)
                    for n in lengths.get(word[i - 2 : i], ()) if i > 1 else ():
                        if n <= i:
                            s = scores.get(word[i - n : i])
                            if s is not None and best[i - n] + s > top:
                                top, piece = best[i - n] + s, word[i - n : i]
                    best.append(top)
                elif i > 1:
                    for n in lengths.get(word[i - 2 : i], ()):
                        if n <= i and (tail := word[i - n : i]) in ids:
                            left = last[i - n]
                            stay = apart.get(key := left + "\0" + tail)
                            if self._stay_apart(left, tail, key) if stay is None else stay:
                                piece = tail
                                break
                last.append(piece)
            found: list[int] = []
            i = len(word)
            while i:
                piece = last[i]
                i -= len(piece)
                known = ids.get(piece)
                if known is not None:
                    found.append(known)
                elif self.has_bytes:
                    found.extend(self.byte_ids[b] for b in reversed(piece.encode()))
                elif not found or found[-1] != self.unknown:  # a run of unknown characters is one unknown
                    found.append(self.unknown)
            out.append(pack(f"<{len(found)}I", *found[::-1]))
            before = word
        return out

    # -- texts --------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of little-endian 32-bit numbers."""
        words = [pre_tokens(t) for t in texts]
        known = self.words(set().union(*words))
        out = [b"".join(map(known.__getitem__, w)) for w in words]
        self.words.trim()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8 where they came from a text; the blank that encoding put first goes."""
        text = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text[1:] if text[:1] == b" " else text


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text, as the library's encode().

    A null or empty text has no ids. Repeated rows are encoded one by one, a null id
    stays null, other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(("codec", model_file), lambda: PieceCodec(model_file))
        for batch in batches:
            for part, texts in slices(batch):
                ids = codec.encode(texts)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))], names=["doc_id", "ids"])

    return rows.mapInArrow(lean(run, keeps=True), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row's ids; null ids and null members count as none.

    A text comes back as it was, but for the sign U+2581, which SentencePiece does not
    tell from a blank. Ids outside the file raise an error.
    """
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.filter(F.col(ids_col).cast("array<int>"), lambda x: x.isNotNull()), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(("codec", model_file), lambda: PieceCodec(model_file))
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                flat = np.asarray(ids.values.to_numpy(zero_copy_only=False), dtype=np.int64)
                if len(flat) and not (0 <= flat.min() and flat.max() < len(codec.bytes_of)):
                    raise ValueError("an id is not of this model")
                texts.append(codec.decode(flat.astype("<u4").tobytes()).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(lean(run, keeps=True), "doc_id long, text string")


def piece_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, round_trip: encode_pieces and decode_pieces of every
    row in one pass. ids_crc32 is over the ids as little-endian unsigned 32-bit numbers, decoded_sha256
    over the decoded text's UTF-8; round_trip says that the decoded text is the text (null: empty)."""
    import hashlib
    import zlib

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(("codec", model_file), lambda: PieceCodec(model_file))
        for batch in batches:
            for part, texts in slices(batch):
                ids = codec.encode(texts)
                back = [codec.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([x == t.encode() for x, t in zip(back, texts)], pa.bool_())],
                    names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
                )

    return rows.mapInArrow(lean(run, keeps=True), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
