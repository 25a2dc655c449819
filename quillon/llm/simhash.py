"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius.

A document's terms are its pairs of adjacent words, its ends counting as words; a term
met c times weighs 1 + floor(log2(c)). Each term's hash votes with its weight on every
bit; a tied bit is the one that the document's smallest term hash has there. Fingerprints have 128
bits in 32 hexadecimal digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._hashing import Texts, mix
from quillon.llm._shared import HEAVY_ROWS, checkpointed, looked_up
from quillon.llm._workers import lean

BITS = 128
_U = np.uint64
#: Each byte's bits as the low bits of eight byte lanes, highest bit first, so that 255 votes fit in a lane.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(_U).ravel()
_VOTES = 255
#: Code points worked on at a time, and bytes of text that one sorted range of ids should hold.
_SLICE = 400_000
RANGE_BYTES = 4_000_000
#: Ranges at most, so that what the driver holds of them is bounded (larger ranges sort with spills), and keys
#: drawn for each range that begins at one of them.
MOST_RANGES, DRAWN = 20_000, 8
#: Classes that share a block and are compared with each other at a time: a sixteenth of them, within these bounds.
NEAR_LEAST, NEAR_BLOCK = 64, 1024


def _terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, 44-bit term) packed in one number each, distinct and ascending, and the weights."""
    words = texts.hashes()
    counts = np.diff(texts.first)
    at = texts.first[:-1] + np.arange(texts.n)  # each text's words, led by one mark for its start and end
    marked = np.full(len(words) + texts.n + 1, _U(0x5851F42D4C957F2D))
    inner = np.ones(len(marked), bool)
    inner[at] = inner[-1] = False
    marked[inner] = words
    h = mix(marked[:-1] * _U(0xFF51AFD7ED558CCD) + (marked[1:] ^ (marked[1:] >> _U(29))))
    doc = np.repeat(np.arange(texts.n, dtype=_U), counts + 1)
    full = np.repeat(counts > 0, counts + 1)  # a text without words has no terms
    keys = np.sort(((doc << _U(44)) | (h >> _U(20)))[full])
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    met = np.diff(np.concatenate([first, [len(keys)]]))
    return keys[first], np.frexp(met.astype(np.float64))[1].astype(np.int64)


def fingerprints(texts: list[str]) -> np.ndarray:
    """The fingerprint of each text, as an array of 16 bytes each; all zero for a text without words."""
    cut = Texts(texts)
    keys, weights = _terms(cut)
    out = np.zeros((cut.n, BITS // 8), np.uint8)
    if not len(keys):
        return out
    doc = np.repeat((keys >> _U(44)).astype(np.int64), weights)
    term = np.repeat(keys & _U((1 << 44) - 1), weights)
    votes = np.concatenate([mix(term + _U(1)).view(np.uint8).reshape(-1, 8), mix(term + _U(0x9E3779B97F4A7C15)).view(np.uint8).reshape(-1, 8)], axis=1)
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    totals = np.diff(np.concatenate([starts, [len(doc)]]))
    parts = -(-totals // _VOTES)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    sums = np.add.reduceat(_LANES[votes], np.repeat(starts, parts) + nth * _VOTES, axis=0)
    ones = np.add.reduceat(sums.view(np.uint8).reshape(len(sums), BITS).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    least = np.minimum.reduceat(mix(term + _U(3)), starts)
    tied = np.unpackbits(np.stack([mix(least + _U(1)), mix(least + _U(0x9E3779B97F4A7C15))], axis=1).view(np.uint8), axis=1)
    out[doc[starts]] = np.packbits(2 * ones + tied > totals[:, None], axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that two fingerprints' differing bits stand for, 0 at the least: 1 for equal ones, 0 from half the bits on."""
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return np.where(2 * apart >= BITS, 0.0, np.cos(np.pi * apart / BITS))


def _hex(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints]


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row. A null text is empty; texts without words have the fingerprint of zeros.

    A null id stays null, repeated rows have a row each; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _cut(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_hex(fingerprints(texts)), pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(lean(run), "doc_id long, fingerprint string")


def _cut(rows: Iterator[tuple]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, total = [], [], 0
    for doc, text in rows:
        if texts and total + len(text) > _SLICE:
            yield ids, texts
            ids, texts, total = [], [], 0
        ids.append(doc)
        texts.append(text)
        total += len(text)
    if texts:
        yield ids, texts


def _dealt(rows: DataFrame) -> DataFrame | None:
    """doc_id, text, place, part, copy: the rows dealt to ranges of their order, which `place` gives, and to each
    range a copy of the first row of the one that follows; None without rows."""
    # ascending: ids from the largest to the smallest, null ids, then by the text
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("turned"), F.xxhash64("text").alias("own"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 1).alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).first()
    if not size["n"]:
        return None
    ranges = min(MOST_RANGES, -(-size["bytes"] // RANGE_BYTES))
    rows = rows.withColumn("place", place)
    drawn = rows.where(F.pmod(F.xxhash64("place"), F.lit(max(1, size["n"] // (ranges * DRAWN)))) == 0).select("place").distinct()
    starts = sorted({tuple(size["first"]), *sorted(tuple(r["place"]) for r in drawn.collect())[DRAWN::DRAWN]})
    kind = "struct<none: boolean, turned: long, own: long>"
    known = F.from_json(F.lit("[" + ",".join(f'{{"none":{str(a).lower()},"turned":{b},"own":{c}}}' for a, b, c in starts) + "]"), f"array<{kind}>")
    # the last start that is not after a row's place, by halving steps
    steps = [1 << k for k in range(len(starts).bit_length() - 1, -1, -1)]
    part = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(known, at + step) <= F.col("place"), at + step).otherwise(at))
    heads = [(*x, p, (p - 1) % len(starts)) for p, x in enumerate(starts)]  # the first range follows the last one
    to = rows.sparkSession.createDataFrame([((a, b, c), to) for a, b, c, _, to in heads], f"place {kind}, part int")
    # of several rows at one place, the first text is the head
    copies = rows.join(F.broadcast(to), "place").groupBy("part").agg(F.min("text").alias("text"), F.first("place").alias("place")).select(F.lit(None).cast("long").alias("doc_id"), "text", "place", "part", F.lit(1).alias("copy"))
    dealt = rows.select("doc_id", "text", "place", part.alias("part"), F.lit(0).alias("copy")).unionByName(copies)
    return dealt.repartition(len(starts), "part")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many from the
    start of the next document's text (or all of it), by descending doc_id; the last
    document's next is the first. A null text is empty, a null doc_id comes last, rows of one
    doc_id are ordered by their text's xxhash64, then the text; a lone document is its own next. Whole texts are
    shuffled once, into ranges of about as many rows, read in order row by row; a range also gets a copy of the first
    document of the range that follows it. Ranges begin at documents drawn by a hash of their id and
    text, so that neither outlying ids nor one id of many texts make them uneven.
    """
    dealt = _dealt(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    if dealt is None:
        return docs.sparkSession.createDataFrame([], _EDITED)
    dealt = dealt.sortWithinPartitions("part", "copy", "place", "text").select("doc_id", "text", "copy")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copy"))):
                if held is not None and not held[2]:
                    yield held[0], held[1], row[1]
                held = row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(neighbours(batches)):
            ids, texts, nexts = map(list, zip(*group))
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts)]
            # the next document's own fingerprint is the one of the row after it, but for the group's last
            own = fingerprints([*texts, nexts[-1]])
            changed = fingerprints(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(_hex(own[:-1])), pa.array(_hex(changed)),
                    pa.array(likeness(own[:-1], changed)), pa.array(likeness(own[:-1], own[1:] if _chained(texts, nexts) else fingerprints(nexts))),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return dealt.mapInArrow(lean(run), _EDITED)


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _chained(texts: list[str], nexts: list[str]) -> bool:
    return all(n is t or n == t for n, t in zip(nexts, texts[1:]))


def _grouped(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    group, total = [], 0
    for row in rows:
        group.append(row)
        total += len(row[1])
        if total > _SLICE:
            yield group
            group, total = [], 0
    if group:
        yield group


def near_counts(prints: DataFrame, radius: int = 3) -> DataFrame:
    """fingerprint, n_near: how many other rows' fingerprints differ in at most `radius` bits, for every fingerprint met.

    Equal fingerprints are one class, which is compared once. The 128 bits are cut into radius + 1
    blocks; a table for each block, with that block moved to the front as its key, holds every
    class; two fingerprints within the radius share a key in at least one table and are compared
    in the first such one. Exact: nothing within the radius is missed, nothing beyond it counts. Classes of a common
    key are compared in pairs of blocks of NEAR_BLOCK at most, each by itself; what leaves it are counts, not pairs.
    Rows with a null fingerprint take no part; an empty table gives an empty result.
    """
    blocks = radius + 1
    if BITS % blocks or 32 % (BITS // blocks):
        raise ValueError("radius + 1 must cut 128 into blocks of 32, 16, 8, 4, 2 or 1 bits")
    bits = BITS // blocks
    words = [f"w{i}" for i in range(BITS // 32)]
    classes = prints.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    classes = checkpointed(classes.select("n", *[F.conv(F.substring("fingerprint", 8 * i + 1, 8), 16, 10).cast("long").alias(w) for i, w in enumerate(words)]))

    def key(i: int):
        return F.shiftright(words[i * bits // 32], 32 - bits - i * bits % 32).bitwiseAND(F.lit((1 << bits) - 1))

    table = classes.select("n", *words, F.posexplode(F.array(*[key(i) for i in range(blocks)])).alias("t", "key")).select("n", *words, F.struct("t", "key").alias("at"))
    sizes = checkpointed(table.groupBy("at").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    heavy = checkpointed(sizes.where(F.col("m") > HEAVY_ROWS).select("at"))
    several = looked_up(table, sizes, "at", heavy, F.lit(32)).withColumn("parts", F.ceil(F.col("m") / F.least(F.lit(NEAR_BLOCK), F.greatest(F.lit(NEAR_LEAST), F.col("m") / 16))).cast("int"))
    several = several.withColumn("own", F.pmod(F.xxhash64(*words), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    several = several.select("at.t", "at.key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "n", *words)

    def compare(table: pa.Table) -> pa.Table:
        t, i, j = (table.column(c)[0].as_py() for c in ("t", "i", "j"))
        own, n = table.column("own").to_numpy(), table.column("n").to_numpy()
        w = np.stack([table.column(c).to_numpy() for c in words], axis=1).astype(np.uint64)
        x, y = (np.flatnonzero(own == k) for k in (i, j))
        apart = np.zeros((len(x), len(y)), np.int64)
        for c in range(len(words)):
            apart += np.bitwise_count(w[x, None, c] ^ w[None, y, c])
        near = apart <= radius
        for k in range(t):  # pairs that share an earlier block met there
            block = w[:, k * bits // 32] >> _U(32 - bits - k * bits % 32) & _U((1 << bits) - 1)
            near &= block[x][:, None] != block[None, y]
        if i == j:
            near[np.arange(len(x)), np.arange(len(x))] = False
        found = np.zeros(len(own), np.int64)
        found[x] += near @ n[y]
        if i != j:
            found[y] += n[x] @ near
        hit = np.flatnonzero(found)
        return pa.table([*(table.column(c).take(hit) for c in words), pa.array(found[hit])], names=[*words, "m"])

    links = several.groupBy("t", "key", "i", "j").applyInArrow(compare, ", ".join(f"{w} long" for w in words) + ", m long")
    counts = classes.join(links.groupBy(*words).agg(F.sum("m").alias("m")), words, "left")
    return counts.select(F.lower(F.concat(*[F.lpad(F.hex(w), 8, "0") for w in words])).alias("fingerprint"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_near"))


def with_near_counts(prints: DataFrame, radius: int = 3) -> DataFrame:
    """prints (with a column fingerprint) and n_near beside them, by near_counts."""
    prints = checkpointed(prints)
    counts = checkpointed(near_counts(prints, radius))
    heavy = checkpointed(prints.groupBy("fingerprint").count().where(F.col("count") > HEAVY_ROWS).select("fingerprint"))
    return looked_up(prints, counts, "fingerprint", heavy, F.lit(64), "left").select(*prints.columns, "n_near")
