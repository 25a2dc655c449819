"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A word is a run without ASCII blanks. Every 13 consecutive words have a minimizer, the
smallest hash of the word triples in them, which decides the block they belong to; so equal
windows meet in one block, wherever they stand, and a document need not be factored against
any other. What a document sends to a block are stretches, each as the 64-bit fingerprints of its
windows one word apart; a block orders its stretches by document, indexes their windows, and
factors each stretch greedily against the documents of smaller doc_id: a factor is the longest match
that one of them has from its window on, found among the sorted suffixes, and the next factor begins at
the window after it, so that it can continue in another document. Factors are at least 13 words long and
become duplicate spans. Windows of one block and one fingerprint count as equal; a block
whose minimizers are common, and which counts more than BLOCK_WINDOWS windows in a pass before, is
split by fingerprint, so that equal windows still meet. What a block holds beyond that are equal
windows, one from each slice; chance equals stay at about 10^-13 for each window.

Before anything is shuffled, the documents of a slice are compared with each other: a window
that a smaller document of the slice has too is a duplicate already and is not sent. A passage
of a third of all documents so reaches its block once for each slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._hashing import Texts, mix, span_hashes
from quillon.llm._shared import checkpointed, measured
from quillon.llm._workers import give_back, lean

WINDOW = 13
#: Words of a minimizer, code points of a slice, and bytes of text for each block.
GRAM, SLICE, BLOCK_BYTES = 3, 1_000_000, 4_000_000
#: Windows from which on a block is split by the windows themselves, and the counters that say so: blocks share
#: them beyond that number, and are split together, which is exact too.
BLOCK_WINDOWS, COUNTERS = 1_000_000, 1 << 20
#: Tasks that the blocks are dealt to at most, unless the session shuffles into more partitions.
MOST_TASKS = 20_000
_U = np.uint64
_MOST_WORDS = 255 - WINDOW


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many as its size says."""
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of every n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _stretches(at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where a new stretch of consecutive positions, with equal values beside them, begins."""
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = at[1:] != at[:-1] + 1
        for s in same:
            new[1:] |= s[1:] != s[:-1]
    return np.flatnonzero(new)


def _cover(at: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word after the last) of the stretches of the duplicate windows `at`."""
    first = _stretches(at, doc[at])
    sizes = np.diff(np.append(first, len(at)))
    return doc[at[first]], place[at[first]], place[at[first]] + sizes + window - 1


def _documents(ids: np.ndarray, texts: np.ndarray, counts: np.ndarray) -> bytes:
    """How many documents, the ids by their differences, the keys of their texts, and how many entries each has."""
    return np.concatenate([[len(ids)], np.diff(ids, prepend=0), texts]).astype("<i8").tobytes() + counts.astype("<u4").tobytes()


def _entries(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The document id and the key of the text of each entry of _documents."""
    n = int(np.frombuffer(packed, "<i8", 1)[0])
    whole = np.frombuffer(packed, "<i8", 2 * n, 8)
    counts = np.frombuffer(packed, "<u4", n, 8 + 16 * n)
    return np.repeat(np.cumsum(whole[:n]), counts), np.repeat(whole[n:], counts)


def _inside(cut: Texts, count: int, window: int) -> np.ndarray:
    """The first words of the windows that lie in one text."""
    m = max(0, count - window + 1)
    return np.flatnonzero(cut.doc[:m] == cut.doc[window - 1 :][:m])


def _blocks_of(words: np.ndarray, at: np.ndarray, blocks: int, window: int) -> np.ndarray:
    """The block that the minimizer of each window `at` decides."""
    gram = words.copy()
    for k in range(1, GRAM):
        gram[: len(words) - k] = mix(gram[: len(words) - k] * _U(0xFF51AFD7ED558CCD) + words[k:])
    return (_sliding_min(gram[: len(words) - GRAM + 1], window - GRAM + 1)[at] % _U(blocks)).astype(np.int64)


def _split(block: np.ndarray, hashes: np.ndarray, blocks: int, parts: np.ndarray) -> np.ndarray:
    """The blocks of windows, where a block whose counter in parts is more than 1 is split into as many by fingerprint."""
    many = parts[block % len(parts)]
    return block + np.where(many > 1, (hashes >> _U(32)) % many.astype(_U), _U(0)).astype(np.int64) * blocks


def _slice_rows(ids: np.ndarray, keys: np.ndarray, texts: list[str], blocks: int, window: int, salt: int, parts: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """What a slice sends: (block, documents, places, sizes, fingerprints) and, with a
    negative block, (., documents, starts, stops, .) of the duplicates within the slice. keys tell the texts of one id apart."""
    order = np.lexsort((keys, ids))
    ids, keys, texts = ids[order], keys[order], [texts[i] for i in order]
    cut = Texts(texts)
    words = cut.hashes()
    doc = cut.doc
    inside = _inside(cut, len(words), window)
    if not len(inside):
        return
    place = np.arange(len(words)) - cut.first[doc]
    who = ids[doc]
    hashes = span_hashes(words, inside, inside + window)
    by = np.argsort(hashes, kind="stable")
    ranked = hashes[by]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    smallest = who[inside[by[np.flatnonzero(head)]]][np.cumsum(head) - 1]
    twice = np.zeros(len(inside), bool)
    twice[by] = who[inside[by]] > smallest
    if twice.any():
        own, start, stop = _cover(inside[twice], doc, place, window)
        yield -1 - salt % blocks, _documents(ids[own], keys[own], np.ones(len(own))), start.astype("<i8").tobytes(), stop.astype("<i8").tobytes(), b""
    at = inside[~twice]
    if not len(at):
        return
    block = _split(_blocks_of(words, at, blocks, window), hashes[~twice], blocks, parts)
    begin = _stretches(at, block)
    size = np.diff(np.append(begin, len(at)))
    if size.max() > _MOST_WORDS:  # sizes are sent in a byte
        cuts = -(-size // _MOST_WORDS)
        begin = _ranges(np.zeros(len(size), np.int64), cuts) * _MOST_WORDS + np.repeat(begin, cuts)
        size = np.diff(np.append(begin, len(at)))
    by = np.argsort(block[begin], kind="stable")
    begin, size = begin[by], size[by]
    where, first = block[begin], at[begin]
    prints = np.zeros(len(words), _U)
    prints[inside] = hashes
    cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
    for a, b in zip(cuts, cuts[1:]):
        f, n = first[a:b], size[a:b]
        own, counts = np.unique(doc[f], return_counts=True)
        yield int(where[a]), _documents(ids[own], keys[own], counts), place[f].astype("<u4").tobytes(), n.astype(np.uint8).tobytes(), prints[_ranges(f, n)].astype("<u8").tobytes()


def _ranks(prints: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """By k, for each window, a rank that those share which begin the same 2^k windows (or as many as are left)."""
    ranks = [np.unique(prints, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while step < left.max():
        last = ranks[-1]
        then = np.zeros(len(last), np.int64)
        more = np.flatnonzero(left > step)
        then[more] = last[more + step] + 1
        ranks.append(np.unique(last * (len(last) + 1) + then, return_inverse=True)[1].astype(np.int64))
        step *= 2
    return ranks


def _common(ranks: list[np.ndarray], left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many windows from x on equal those from y on; 0 where y is -1."""
    n = np.zeros(len(x), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        at = np.flatnonzero((y >= 0) & (left[x] - n >= 1 << k) & (left[y] - n >= 1 << k))
        at = at[ranks[k][x[at] + n[at]] == ranks[k][y[at] + n[at]]]
        n[at] += 1 << k
    return n


def _smaller_before(doc: np.ndarray) -> np.ndarray:
    """For each entry, the nearest one before it with a smaller document, or -1."""
    docs, before = doc.tolist(), []
    for i, d in enumerate(docs):
        j = i - 1
        while j >= 0 and docs[j] >= d:
            j = before[j]
        before.append(j)
    return np.array(before, np.int64)


def _factors(who: np.ndarray, prints: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, reference window, windows) of the greedy factors: each is the longest match, from its window on,
    that a smaller document has, and the next begins where it ends. Windows are ordered by document."""
    by = np.argsort(prints, kind="stable")
    ranked = prints[by]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    ends = np.append(np.flatnonzero(head), len(by))
    several = np.empty(len(by), bool)
    several[by] = (who[by[ends[:-1]]] < who[by[ends[1:] - 1]])[np.cumsum(head) - 1]
    at = np.flatnonzero(several)  # no other window is in a match, or ends one early
    if not len(at):
        return at, at, at
    who, begin = who[at], _stretches(at, run[at])
    stop = np.append(begin[1:], len(at))
    left = np.repeat(stop, stop - begin) - np.arange(len(at))
    ranks = _ranks(prints[at], left)
    order = np.argsort(ranks[-1], kind="stable")  # the index of all suffixes: the longest matches are next to each other
    length, match = np.zeros(len(at), np.int64), np.full(len(at), -1)
    for suffixes in (order, order[::-1]):
        near = _smaller_before(who[suffixes])
        near = np.where(near >= 0, suffixes[near], -1)
        n = _common(ranks, left, suffixes, near)
        better = n > length[suffixes]
        length[suffixes[better]], match[suffixes[better]] = n[better], near[better]
    found = []
    now, stop = begin, stop
    while len(now):
        found.append(now[length[now] > 0])
        now = now + np.maximum(length[now], 1)
        now, stop = now[now < stop], stop[now < stop]
    first = np.sort(np.concatenate(found))
    return at[first], at[match[first]], length[first]


def _parse_block(doc: np.ndarray, key: np.ndarray, place: np.ndarray, size: np.ndarray, prints: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Duplicate spans (document, text, start, stop) of a block's stretches: document, key of the text and place of each
    stretch's first word, its number of windows, and the fingerprints of all windows."""
    order = np.lexsort((place, key, doc))  # references come first
    offset = np.cumsum(size) - size
    size = size[order]
    prints = prints[_ranges(offset[order], size)]
    who, text = np.repeat(doc[order], size), np.repeat(key[order], size)
    where = _ranges(place[order], size)
    run = np.cumsum(np.concatenate([[True], (who[1:] != who[:-1]) | (text[1:] != text[:-1]) | (where[1:] != where[:-1] + 1)]))
    first, _, length = _factors(who, prints, run)
    found = _ranges(first, length)
    begin = _stretches(found, run[found])  # factors that meet become one span
    length = np.diff(np.append(begin, len(found)))
    first = found[begin]
    return who[first], text[first], where[first], where[first] + length + window - 1


def _parts(rows: DataFrame, blocks: int, window: int) -> np.ndarray:
    """By counter (of the blocks equal to it modulo their number), how many blocks each of its blocks is split into."""
    counters = min(blocks, COUNTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = np.zeros(counters, np.int64)

        def add(texts: list[str]) -> None:
            cut = Texts(texts)
            words = cut.hashes()
            at = _inside(cut, len(words), window)
            if len(at):
                windows[:] += np.bincount(_blocks_of(words, at, blocks, window) % counters, minlength=counters)

        texts: list[str] = []
        held = 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                texts.append(t)
                held += len(t)
                if held > SLICE:
                    add(texts)
                    texts, held = [], 0
        if texts:
            add(texts)
        some = np.flatnonzero(windows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(windows[some])], names=["block", "n"])

    counted = rows.select("text").mapInArrow(lean(count), "block long, n long").groupBy("block").agg(F.sum("n").alias("n"))
    parts = np.ones(counters, np.int64)
    usual = BLOCK_WINDOWS * -(-blocks // counters)
    for r in counted.where(F.col("n") > usual).collect():  # at most one row for each counter
        parts[r["block"]] = -(-2 * r["n"] // usual)
    return parts


def duplicate_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, start, stop: word ranges that `window`-word sequences cover which also start in a smaller doc_id.

    text_key is the text's xxhash64. Ranges of one document can overlap. Null texts have no words; rows with a null
    id take no part. Rows of one doc_id are no references for each other; each has the ranges of its own text.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    parts = _parts(rows, blocks, window)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() * 7919
        ids: list[int] = []
        keys: list[int] = []
        texts: list[str] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal ids, keys, texts, held, salt
            salt += 1
            for row in _slice_rows(np.array(ids, np.int64), np.array(keys, np.int64), texts, blocks, window, salt, parts):
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["block", "docs", "places", "sizes", "prints"])
            ids, keys, texts, held = [], [], [], 0

        for batch in batches:
            for i, k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                keys.append(k)
                texts.append(t)
                held += len(t)
                if held > SLICE:
                    yield from out()
        if ids:
            yield from out()

    def parse(table: pa.Table) -> pa.Table:
        column = lambda c: [x.as_py() for x in table.column(c)]
        doc, key = map(np.concatenate, zip(*map(_entries, column("docs"))))
        if table.column("block")[0].as_py() < 0:
            start, stop = (np.concatenate([np.frombuffer(x, "<i8") for x in column(c)]) for c in ("places", "sizes"))
        else:
            join = lambda c, kind: np.frombuffer(b"".join(column(c)), kind)
            doc, key, start, stop = _parse_block(doc, key, join("places", "<u4").astype(np.int64), join("sizes", np.uint8).astype(np.int64), join("prints", "<u8"), window)
        found = pa.table([pa.array(x, pa.int64()) for x in (doc, key, start, stop)], names=["doc_id", "text_key", "start", "stop"])
        del doc, key, start, stop
        give_back()
        return found

    sent = rows.mapInArrow(lean(send), "block long, docs binary, places binary, sizes binary, prints binary")
    # tasks of a few blocks each, however many partitions the session shuffles into
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, MOST_TASKS))
    return sent.repartition(tasks, "block").groupBy("block").applyInArrow(parse, "doc_id long, text_key long, start long, stop long")


def _kept(text: str, spans: list[int] | None) -> tuple[int, int, bytes]:
    """Number of words, of removed words, and the kept words joined by a blank. spans: start << 32 | stop."""
    words = text.encode().split()  # bytes split at the blanks 9 to 13 and 32
    if not spans:
        return len(words), 0, b" ".join(words)
    spans = np.array(spans, np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.minimum(spans >> 32, len(words)), 1)
    np.add.at(edge, np.minimum(spans & 0xFFFFFFFF, len(words)), -1)
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return len(words), len(words) - len(keep), b" ".join([words[i] for i in keep.tolist()])


def _merged(spans: Column) -> Column:
    """Sorted ranges (start << 32 | stop) with those that meet or overlap made one."""
    stop = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.shiftleft(F.shiftright(last, 32), 32).bitwiseOR(F.greatest(stop(last), stop(x)))))
        return F.when((F.size(done) > 0) & (F.shiftright(x, 32) <= stop(last)), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast("array<bigint>"), add)


def _with_spans(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    spans = duplicate_spans(docs, window, id_col, text_col)
    spans = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("stop")))).alias("__spans"))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), _merged(F.col("__spans")).alias("__spans"))
    side = measured(checkpointed(spans), F.size("__spans") * 8 + 32)
    return docs.join(side, (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text_col) == F.col("__text")), "left")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every column, and text, n_words, n_removed: where words were removed, text is the kept
    ones joined by a blank, else it is as it was. Columns of docs named n_words or n_removed are replaced.

    A null text stays null and has no words, an empty one has none either; rows with a null id keep all words.
    A repeated row loses the same words as the other; rows of one doc_id with other texts are judged each by itself,
    against smaller ids only. An empty table gives an empty result.
    """
    plain = docs.drop("n_words", "n_removed", "__spans", "__id", "__text")
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            cut = [_kept(t or "", s) for t, s in zip(texts, b.column("__spans").to_pylist())]
            own = pa.array([t if not r else k.decode() for t, (_, r, k) in zip(texts, cut)], pa.string())
            yield pa.RecordBatch.from_arrays([*(own if c == text_col else b.column(c) for c in names), pa.array([n for n, _, _ in cut], pa.int64()), pa.array([r for _, r, _ in cut], pa.int64())], names=[*names, "n_words", "n_removed"])

    from pyspark.sql import types as T

    schema = T.StructType([*plain.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return _with_spans(plain, window, id_col, text_col).select(*names, "__spans").mapInArrow(lean(run), schema)


def substring_digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a blank) of every row, by the rules of dedup_substrings; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [_kept(t or "", s) for t, s in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _, _ in cut], pa.int64()), pa.array([r for _, r, _ in cut], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for _, _, k in cut], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _with_spans(rows, window, "doc_id", "text").select("doc_id", "text", "__spans").mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: The same rows in DuckDB, on the windows' texts.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)),
m AS (SELECT win, min(doc_id) AS low FROM w GROUP BY win HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT w.doc_id, w.i + k AS p FROM w JOIN m USING (win) CROSS JOIN range(13) AS t(k) WHERE w.doc_id > m.low),
l AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, d.words, l.gone, CASE WHEN l.gone IS NULL THEN d.words ELSE list_transform(list_filter(range(1, len(d.words) + 1), lambda i: NOT list_contains(l.gone, i)), lambda i: d.words[i]) END AS kept
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(kept) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
