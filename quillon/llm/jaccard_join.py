"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. Documents of one set are one class, and a
class is joined once. A run splits all classes on a sampled token - the smallest under a hash
that the run chose - and goes on in each node with another token, chosen by the node's path,
until a node has at most LEAF classes or lies DEPTH deep. Two sets of similarity s stay together
in a node of depth d with probability s^d, so that runs are repeated until a pair at the
threshold has met with the target recall even at DEPTH. The classes of a node are then compared
by brute force, with their whole sets: a pair in the first run that brought it together, and
a node whose pairs have all met before not at all. Nodes of more than BLOCK classes are
compared in pairs of blocks, each a task of its own.

What leaves a task are counts of links for each class and one edge for each class, to the
smallest class that it is connected with there: as many rows as classes, not as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._hashing import Texts, mix, span_hashes
from quillon.llm._shared import HEAVY_ROWS, checkpointed, heavy_keys, looked_up, measured
from quillon.llm._workers import lean

WORDS, SIMILARITY, RECALL = 5, (4, 5), 0.999
DEPTH, LEAF, BLOCK = 3, 512, 256
#: Bytes of sets from which on a node has more blocks than its number of classes asks for, and of sets in a record batch.
BLOCK_BYTES, _BATCH_BYTES = 16_000_000, 4_000_000
_SLICE = 250_000
_U = np.uint64
#: A class: its smallest doc_id, which another text can have too, and its set's keys. Smaller ids come first.
_REP = "struct<id: long, a: long, b: long>"
_REP_ARROW = pa.struct([("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def runs_needed(similarity: float, recall: float, depth: int) -> int:
    """Runs until a pair of this similarity has met in a node of this depth with the recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth)))


RUNS = runs_needed(SIMILARITY[0] / SIMILARITY[1], RECALL, DEPTH)


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, text by text and ascending, and where each text's begin (and end).

    A shingle is so many words; a text of fewer words is one shingle of them all, one without words has none.
    """
    cut = Texts(texts)
    counts = np.diff(cut.first)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    begin = np.repeat(cut.first[:-1] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    end = np.minimum(begin + words, np.repeat(cut.first[1:], sizes))
    h = span_hashes(cut.hashes(), begin, end)
    doc = np.repeat(np.arange(cut.n), sizes)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(cut.n + 1))


def _sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    return total[limits[1:]] - total[limits[:-1]]


def set_keys(h: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys that equal sets share, whatever the order of their members."""
    return _sums(mix(h + _U(11)), limits).view(np.int64), _sums(mix(h ^ _U(0x6A09E667F3BCC909)), limits).view(np.int64)


def paths(h: np.ndarray, limits: np.ndarray, runs: int) -> np.ndarray:
    """(texts, DEPTH * runs): the node of each depth that each run leads a set to; texts with an empty set are left as 0.

    The hash whose minimum splits a node is chosen by the node's path, run included: no two depths or runs share one.
    """
    sizes = np.diff(limits)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), DEPTH * runs), np.int64)
    if not len(full):
        return out
    sizes = sizes[full]
    for r in range(runs):
        node = np.full(len(full), mix(np.array([r + 1], _U))[0])
        for d in range(DEPTH):
            token = np.minimum.reduceat(mix(h ^ (np.repeat(node, sizes) if d else node[0])), limits[full])
            node = mix(node * _U(0xFF51AFD7ED558CCD) + token)
            out[full, d * runs + r] = (node | _U(1)).view(np.int64)  # 0 means no node
    return out


def _slices(ids: list, texts: list[str]) -> Iterator[slice]:
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > _SLICE:
            yield slice(start, i)
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _signatures(rows: DataFrame, words: int, runs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, own, texts = b.column("doc_id"), b.column("own_text"), b.column("text").to_pylist()
            for at in _slices(ids, texts):
                h, limits = shingle_sets(texts[at], words)
                a, c = set_keys(h, limits)
                p = paths(h, limits, runs)
                n = len(p)
                yield pa.RecordBatch.from_arrays([ids.slice(at.start, n), own.slice(at.start, n), pa.array(a), pa.array(c), pa.array(np.diff(limits), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))], names=["doc_id", "own_text", "a", "b", "size", "paths"])

    return rows.mapInArrow(lean(run), "doc_id long, own_text long, a long, b long, size long, paths array<long>")


def _exploded(classes: DataFrame, runs: int) -> DataFrame:
    """rep, size, run, and n0, n1, ...: the node of each depth that each run leads each class to."""
    rows = classes.select("rep", "size", F.posexplode(F.slice("paths", 1, runs)).alias("run", "n0"), "paths").where("n0 <> 0")
    return rows.select("rep", "size", "run", "n0", *[F.element_at("paths", F.col("run") + F.lit(1 + d * runs)).alias(f"n{d}") for d in range(1, DEPTH)])


def _leaves(classes: DataFrame, runs: int) -> DataFrame:
    """rep, run, leaf, n, bytes: the node in which each run ends for each class that is not alone there, its classes and the size of their sets.

    A node's classes and bytes are counted in each task first. The few nodes of more than LEAF classes are looked up by
    looked_up, those of more than one by a join whose keys have at most LEAF rows.
    """
    rows, done = _exploded(classes, runs), []
    for d in range(DEPTH):
        node = f"n{d}"
        sizes = checkpointed(rows.groupBy(node).agg(F.count(F.lit(1)).alias("n"), (F.sum("size") * 8).alias("bytes")).where("n > 1"))
        heavy = checkpointed(sizes.where(F.col("n") > min(LEAF, HEAVY_ROWS)).select(node))
        met = looked_up(rows, sizes, node, heavy, F.lit(32))
        last = d == DEPTH - 1
        done.append((met if last else met.where(F.col("n") <= LEAF)).select("rep", "run", F.col(node).alias("leaf"), "n", "bytes"))
        large = sizes.where(F.col("n") > LEAF)
        if last or large.limit(1).count() == 0:
            break
        rows = checkpointed(met.where(F.col("n") > LEAF).select("rep", "size", "run", *[f"n{k}" for k in range(d + 1, DEPTH)]))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _tasks(leaves: DataFrame, runs: int) -> DataFrame:
    """rep, places, tasks: each class's leaf by run (0: none), and the block pairs to compare it in."""
    blocks = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))).cast("int").alias("blocks")
    places = [F.coalesce(F.max(F.when(F.col("run") == r, F.col("leaf"))), F.lit(0)).alias(f"p{r}") for r in range(runs)]
    classes = checkpointed(leaves.select("rep", "run", "leaf", "n", blocks).groupBy("rep").agg(F.collect_list(F.struct("run", "leaf", "n", "blocks")).alias("ends"), *places))
    own = [f"p{r}" for r in range(runs)]
    rows = classes.select("rep", F.explode("ends").alias("end"), *own).select("rep", "end.*", *own)
    # a leaf whose classes share the leaf of an earlier run has only pairs that met there
    met = F.lit(False)
    bounds = []
    for r in range(runs - 1):
        bounds += [F.min(f"p{r}").alias(f"low{r}"), F.max(f"p{r}").alias(f"high{r}")]
        met = met | ((F.lit(r) < F.col("run")) & (F.col(f"low{r}") == F.col(f"high{r}")) & (F.col(f"low{r}") != 0))
    fresh = checkpointed(rows.groupBy("leaf", "run").agg(*bounds, F.max("n").alias("n")).where(~met).select("leaf", "n", F.lit(True).alias("new")))
    heavy = checkpointed(fresh.where(F.col("n") > HEAVY_ROWS).select("leaf"))
    dealt = looked_up(rows.select("rep", "run", "leaf", "blocks"), fresh.select("leaf", "new"), "leaf", heavy, F.lit(32))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", "leaf"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = dealt.groupBy("rep").agg(F.collect_list(F.struct("leaf", "run", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")).alias("tasks"))
    return tasks.join(classes.select("rep", F.array(*own).alias("places")), "rep")


def _shared_members(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many members each set of a has in common with each of b (with each of a, if b is None)."""
    sets = a if b is None else a + b
    codes = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(codes, kind="stable")
    codes, row = codes[order], row[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    row, column = row[often], column[often]
    common = np.zeros((len(a), len(a if b is None else b)), np.float32)
    if len(row):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        width = 4096
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            m = np.zeros((len(sets), min(width, int(column[-1]) + 1 - k * width)), np.float32)
            m[row[x:y], column[x:y] - k * width] = 1
            common += m[: len(a)] @ (m if b is None else m[len(a) :]).T
    return common


def _compare(copies: np.ndarray, sets: list[np.ndarray], places: np.ndarray, own: np.ndarray, run: int, i: int, j: int, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, their linked documents, the smallest class each is connected with) of a block pair's linked classes, by number."""
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    if not len(left) or not len(right):
        return left[:0], copies[:0], left[:0]
    size = np.array([len(s) for s in sets])
    common = _shared_members([sets[x] for x in left], None if i == j else [sets[x] for x in right]).astype(np.int64)
    num, den = similarity
    hit = common * (den + num) >= num * (size[left][:, None] + size[right][None, :])
    x, y = np.nonzero(np.triu(hit, 1) if i == j else hit)
    x, y = left[x], right[y]
    fresh = ~((places[x, :run] == places[y, :run]) & (places[x, :run] != 0)).any(axis=1)
    x, y = x[fresh], y[fresh]
    count = np.bincount(x, weights=copies[y], minlength=len(copies)) + np.bincount(y, weights=copies[x], minlength=len(copies))
    root = np.arange(len(copies))
    while len(x):  # the smallest label spreads along the links
        low = np.minimum(root[x], root[y])
        if (root[x] == low).all() and (root[y] == low).all():
            break
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
    linked = np.flatnonzero(count)
    return linked, count[linked].astype(np.int64), root[linked]


def _links(docs: DataFrame, tasks: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """rep, n, root: of each task, the linked classes."""
    side = measured(checkpointed(tasks), F.size("tasks") * 32 + F.size("places") * 8 + 64)
    # by the text as well: a doc_id of many texts meets each of its classes' texts once
    rows = docs.join(side, (docs["doc_id"] == side["rep"]["id"]) & (docs["own_text"] == side["rep_text"])).select("rep", "copies", "places", "tasks", "text")

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), _REP_ARROW, pa.int64(), pa.binary(), pa.binary()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for at in _slices(texts, texts):
                part = b.slice(at.start, at.stop - at.start)
                h, limits = shingle_sets(texts[at], words)
                keys = list(zip(*(k.tolist() for k in set_keys(h, limits))))
                out: list[list] = [[] for _ in range(9)]
                for n, r in enumerate(part.select(["rep", "copies", "places", "tasks"]).to_pylist()):
                    if keys[n] != (r["rep"]["a"], r["rep"]["b"]):
                        continue  # another row of the same doc_id
                    codes = h[limits[n] : limits[n + 1]].astype("<u8").tobytes()
                    for t in r["tasks"]:
                        for column, value in zip(out, (t["leaf"], t["run"], t["i"], t["j"], t["own"], r["rep"], r["copies"], np.array(r["places"][: t["run"]], "<i8").tobytes(), codes)):
                            column.append(value)
                ends = np.cumsum([len(c) for c in out[-1]]) // _BATCH_BYTES
                cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(out[0])]
                for s, e in zip(cuts, cuts[1:]):
                    yield pa.RecordBatch.from_arrays([pa.array(c[s:e], k) for c, k in zip(out, kinds)], names=["leaf", "run", "i", "j", "own", "rep", "copies", "places", "codes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]

        def flush() -> pa.RecordBatch:
            nonlocal out
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (_REP_ARROW, pa.int64(), _REP_ARROW))], names=["rep", "n", "root"])
            out = [[], [], []]
            return done

        def close(key: tuple, group: list[tuple]) -> None:
            classes = {(r[0]["id"], r[0]["a"], r[0]["b"]): r for r in group}  # a repeated row is one class
            group = [classes[c] for c in sorted(classes)]
            if len(group) < 2:
                return
            run = key[1]
            found = _compare(
                np.array([r[1] for r in group], np.int64), [np.frombuffer(r[3], "<u8") for r in group],
                np.frombuffer(b"".join(r[2] for r in group), "<i8").reshape(len(group), run), np.array([r[4] for r in group]), run, key[2], key[3], similarity,
            )
            reps = [r[0] for r in group]
            for column, value in zip(out, ([reps[i] for i in found[0]], found[1].tolist(), [reps[i] for i in found[2]])):
                column.extend(value)

        key, group = None, []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("leaf", "run", "i", "j")]
            values = zip(*(b.column(c).to_pylist() for c in ("rep", "copies", "places", "codes", "own")))
            for k, v in zip(zip(*columns), values):
                if k != key:
                    if key is not None:
                        close(key, group)
                    key, group = k, []
                group.append(v)
            if len(out[0]) > 1000:
                yield flush()
        if key is not None:
            close(key, group)
        yield flush()

    spread_out = rows.mapInArrow(lean(spread), f"leaf long, run int, i int, j int, own int, rep {_REP}, copies long, places binary, codes binary")
    return spread_out.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "run", "i", "j").mapInArrow(lean(compare), f"rep {_REP}, n long, root {_REP}")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of the edges (u, v) is connected with.

    Every node hands its label to its neighbours and takes the label of its label, until none
    changes; the tables of each round are checkpointed and stay distributed.
    """
    both = checkpointed(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")))
    hubs = heavy_keys(both, "v", "v")
    while True:
        low = looked_up(both, labels.select(F.col("node").alias("v"), "label"), "v", hubs, F.lit(64)).groupBy("u").agg(F.min("label").alias("low"))
        better = checkpointed(labels.join(low, labels["node"] == low["u"]).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label")))
        jump = better.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = looked_up(better, jump, "label", heavy_keys(better, "label", "label"), F.lit(64)).select("node", "old", F.least("label", "far").alias("label"))
        moved = checkpointed(moved)
        changed = moved.where("old <> label").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels


def jaccard_join(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, copy_id, n_links, text_key, stays of every row with an id.

    copy_id is the smallest doc_id with the same shingle set; class_id the smallest doc_id that
    links lead to; n_links how many other rows have a similarity (a fraction: num, den) or more
    with the row, its copies included. Each pair of different sets is found with probability
    recall or more, and is then decided on the whole sets. A null text is empty; texts without
    words are copies of each other. Rows with a null id take no part and are left out. Rows that
    repeat a doc_id with the same text are copies; with another text they are documents of their
    own under one id, told apart by text_key, the xxhash64 of the text (null: empty). stays is true for the one
    document of a class that has its smallest id (the smallest text_key, if several do), in each row that repeats it. An
    empty table gives an empty result; other columns are not read.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("own_text", F.xxhash64("text"))
    runs = runs_needed(similarity[0] / similarity[1], recall, DEPTH)
    signed = checkpointed(_signatures(rows, words, runs))
    least = F.min(F.struct("doc_id", "own_text", "size", "paths")).alias("least")
    first = signed.groupBy("a", "b").agg(least, F.count(F.lit(1)).alias("copies"))
    first = checkpointed(first.select(F.struct(F.col("least.doc_id").alias("id"), "a", "b").alias("rep"), "copies", F.col("least.own_text").alias("rep_text"), "least.size", "least.paths"))
    classes = first.select("rep", "rep_text", F.col("rep.a").alias("a"), F.col("rep.b").alias("b"), "copies")
    tasks = _tasks(_leaves(first, runs), runs).join(first.select("rep", "rep_text", "copies"), "rep")
    links = checkpointed(_links(rows, tasks, words, similarity))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    labels = components(links.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    found = classes.join(counts, "rep", "left").join(labels, classes["rep"] == labels["node"], "left")
    lowest = F.coalesce(F.col("label") == F.col("rep"), F.lit(True))
    found = found.select(F.struct("a", "b").alias("keys"), F.coalesce("label", "rep")["id"].alias("class_id"), F.when(lowest, F.col("rep_text")).alias("rep_text"), F.col("rep.id").alias("copy_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    many = checkpointed(first.where(F.col("copies") > HEAVY_ROWS).select(F.struct("rep.a", "rep.b").alias("keys")))
    rows = signed.select("doc_id", "own_text", F.struct("a", "b").alias("keys"))
    stays = (F.col("doc_id") == F.col("class_id")) & F.coalesce(F.col("own_text") == F.col("rep_text"), F.lit(False))
    return looked_up(rows, found, "keys", many, F.lit(64)).select("doc_id", "class_id", "copy_id", "n_links", F.col("own_text").alias("text_key"), stays.alias("stays"))
