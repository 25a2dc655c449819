"""Exact top-k search by inner product, by no-random-access aggregation over sorted lists.

Candidates stay where they are: a task holds a block of them and has two sorted lists for each
component, its values descending, which a query with a positive weight there reads, and ascending for a
negative one. A chunk of queries of bounded size goes to all blocks and reads their lists in step. By a
depth, a candidate's score lies between what the lists showed of it plus the worst, and plus the best, that its
unseen components can still bring: the list's far end, and its current value. A query stops
reading once few candidates' upper bounds reach its floor: the k-th best lower bound, or the k-th best
score of the blocks finished before, whichever is higher. The final scores of those that are left are then resolved.
A first block, the same for all tasks, is finished before the others, so that none begins without a floor.

Equal vectors of a block are one candidate: a query needs at most k + 1 of their ids. What leaves a task are
its k best for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._shared import checkpointed
from quillon.llm._workers import lean

#: Vectors of a candidate block and of the first one, bytes of a chunk of queries, and pairs resolved at a time.
CANDIDATES, FIRST, CHUNK_BYTES, PAIRS = 8192, 4096, 16_000_000, 1 << 18
#: Parts of the lists read between two looks at the bounds.
STEPS = (0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 1.0)
#: A query stops reading once one of so many candidates is left.
LEFT = 16
_NONE = -(2**63)


def _left(values: np.ndarray, queries: np.ndarray, floor: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidates, queries, entries read by each query): the pairs whose upper bound reaches the query's floor where it stops.

    values and queries: whole numbers in a type that their products and sums are exact in; floor: -inf where none is known;
    need: how many lower bounds a floor of this block needs below it.
    """
    n, d = values.shape
    ranked = np.sort(values, axis=0)
    plus, minus = np.maximum(queries, 0).T, np.minimum(queries, 0).T
    floor = floor.copy()
    reading, read = np.arange(len(queries)), np.zeros(len(queries), np.int64)
    rows, asks = [], []
    for step in STEPS:
        depth = min(n, int(np.ceil(step * n)))
        high, low = ranked[n - depth], ranked[depth - 1]  # the lists' current values
        up, down = plus[:, reading], minus[:, reading]
        # what was seen is at least (at most, for a negative weight) the current value; the rest counts as that value
        upper = np.maximum(values, high) @ up + np.minimum(values, low) @ down
        blind = np.flatnonzero(np.isneginf(floor[reading]))
        if len(blind) and need <= n:
            lower = np.where(values >= high, values, ranked[0]) @ up[:, blind] + np.where(values <= low, values, ranked[-1]) @ down[:, blind]
            known = np.partition(lower, n - need, axis=0)[n - need] - (4096 if lower.dtype == np.int64 else 0)  # floats hold the floor
            upper_floor = floor[reading]
            upper_floor[blind] = known
        else:
            upper_floor = floor[reading]
        reach = upper >= upper_floor  # with equality: a tie may have the smaller vec_id
        stop = (reach.sum(axis=0) <= max(4 * need, n // LEFT)) | (depth == n)
        read[reading] = depth * d
        which = np.flatnonzero(stop)
        row, ask = np.nonzero(reach[:, which])
        rows.append(row)
        asks.append(reading[which[ask]])
        reading = reading[~stop]
        if not len(reading):
            break
    return np.concatenate(rows), np.concatenate(asks), read


class _Search:
    """The k best of each query of a chunk, over the blocks that a task adds."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        self.queries, self.own, self.floor, self.k = queries, own, floor.copy(), k
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in own]  # (-score, vec_id, key of the vector)
        self.read = self.entries = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        values, group = np.unique(vectors, axis=0, return_inverse=True)
        by = np.lexsort((ids, group))
        rank = np.arange(len(by)) - np.searchsorted(group[by], group[by])
        new = np.ones(len(by), bool)
        new[1:] = (ids[by][1:] != ids[by][:-1]) | (group[by][1:] != group[by][:-1])  # rows that repeat are one
        if not new.all():
            by = by[new]
            rank = np.arange(len(by)) - np.searchsorted(group[by], group[by])
        by, rank = by[rank <= self.k], rank[rank <= self.k]
        held = np.full((len(values), self.k + 1), _NONE, np.int64)
        held[group[by], rank] = ids[by]
        keys = _keys(values)
        bound = float(np.abs(self.queries).max(initial=0)) * float(np.abs(values).max(initial=0)) * values.shape[1]
        if bound >= 2**62:
            raise ValueError("the vectors' components are too large for scores of 64 bits")
        # sums of products stay exact in the narrower types below these bounds
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        floor = self.floor if kind is not np.int64 else np.where(np.isneginf(self.floor), self.floor, self.floor - 2.0**12)
        v, q = values.astype(kind), self.queries.astype(kind)
        row, ask, read = _left(v, q, floor, self.k + 1)
        self.read += int(read.sum())
        self.entries += v.size * len(q)
        for a in range(0, len(row), PAIRS):
            r, s = row[a : a + PAIRS], ask[a : a + PAIRS]
            self._resolved(s, held[r], keys[r], (v[r] * q[s]).sum(axis=1).astype(np.int64))

    def _resolved(self, ask: np.ndarray, ids: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        width = ids.shape[1]
        ask, keys, scores, ids = np.repeat(ask, width), np.repeat(keys, width), np.repeat(scores, width), ids.ravel()
        keep = np.flatnonzero((ids != _NONE) & (ids != self.own[ask]))
        keep = keep[np.lexsort((keys[keep], ids[keep], -scores[keep], ask[keep]))]
        rank = np.arange(len(keep)) - np.searchsorted(ask[keep], ask[keep])
        keep = keep[rank < self.k]
        if not len(keep):
            return
        cuts = np.flatnonzero(np.concatenate([[True], ask[keep][1:] != ask[keep][:-1], [True]]))
        score, doc, key = (-scores[keep]).tolist(), ids[keep].tolist(), keys[keep].tolist()
        for a, b in zip(cuts.tolist(), cuts.tolist()[1:]):
            i = int(ask[keep[a]])
            self.best[i] = sorted({*self.best[i], *zip(score[a:b], doc[a:b], key[a:b])})[: self.k]
            if len(self.best[i]) == self.k:
                self.floor[i] = max(self.floor[i], -self.best[i][-1][0])

    def rows(self) -> pa.RecordBatch:
        columns: list[list[int]] = [[], [], [], [], []]
        own_keys = _keys(self.queries).tolist()
        for i, best in enumerate(self.best):
            for score, doc, key in best:
                for column, value in zip(columns, (int(self.own[i]), own_keys[i], doc, key, -score)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "own", "vec_id", "key", "score"])


def _keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of each vector, by which equal rows of several tasks are known."""
    h = np.zeros(len(values), np.uint64)
    for c in values.astype(np.int64).T:
        h ^= c.view(np.uint64)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _vectors(column: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the rows of a list column and their vectors as whole numbers."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale)
    if len(whole) and np.abs(whole).max() >= 2.0**62:
        raise ValueError("the vectors' components are too large for scores of 64 bits")
    starts, found = np.cumsum(sizes) - sizes, {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        found[d] = rows, whole[starts[rows][:, None] + np.arange(d)].astype(np.int64)
    return found


def _searching(queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, scale: int):
    """A mapInArrow function over candidates. queries: by length, ids, vectors and floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = queries if isinstance(queries, dict) else queries.value
        searches = {d: _Search(v, own, floor, k) for d, (own, v, floor) in given.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {d: [] for d in searches}

        def close(d: int) -> None:
            if held[d]:
                searches[d].add(*map(np.concatenate, zip(*held[d])))
            held[d] = []

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for d, (rows, v) in _vectors(batch.column("v"), scale).items():
                for a in range(0, len(rows) if d in searches else 0, CANDIDATES):
                    held[d].append((ids[rows[a : a + CANDIDATES]], v[a : a + CANDIDATES]))
                    if sum(len(x) for x, _ in held[d]) >= CANDIDATES:
                        close(d)
        for d, search in searches.items():
            close(d)
            yield search.rows()

    return run


#: own and key: of the query's vector and of the candidate's.
_FOUND = "query_id long, own long, vec_id long, key long, score long"


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of every query.

    Components become floor(scale * x) of x as double. Queries are the rows whose id is
    divisible by `every`; candidates all rows but those of the query's own id. Ties go to the
    smaller vec_id. Fewer candidates than k give fewer rows. Rows with a null id, a null or empty vector
    or a null, NaN or infinite component take no part, nor do queries of another length than a
    candidate with it. Rows of one id are one row if their vectors are equal, else each is one. Vectors whose scores
    could leave 64 bits raise an error. An empty table gives an empty result; other columns are not read.

    Vectors are not shuffled. Queries are read by the driver in chunks of CHUNK_BYTES, one at a time, and each
    chunk is sent to the candidates; what is shuffled are the k best of each query and task.
    """
    x = F.col(vector_col).cast("array<double>")
    fit = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))
    queries = checkpointed(rows.where(F.col("vec_id") % every == 0).distinct())
    size = queries.agg(F.sum(F.size("v").cast("long") * 8 + 32)).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    found = []
    for c in range(chunks):
        chunk = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)) == c).toArrow()
        ids, asked = chunk.column("vec_id").to_numpy(), {}
        for d, (at, v) in _vectors(chunk.column("v").combine_chunks(), scale).items() if len(ids) else ():
            asked[d] = ids[at], v, np.full(len(at), -np.inf)
        # the floors that one block leaves are those of all others
        first = rows.limit(FIRST).mapInArrow(lean(_searching(asked, k, scale)), _FOUND)
        kth = first.groupBy("query_id", "own").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        floors = {(r["query_id"], r["own"]): r["low"] for r in kth.collect()}
        for d, (own, v, floor) in asked.items():
            floor[:] = [floors.get(key, -np.inf) for key in zip(own.tolist(), _keys(v).tolist())]
        shared = vectors.sparkSession.sparkContext.broadcast(asked)
        found.append(checkpointed(rows.mapInArrow(lean(_searching(shared, k, scale)), _FOUND)))
        shared.destroy()
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "own", "key")
    return best.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same rows in DuckDB, by scoring every pair.
ORACLE_SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
