"""Exact top-k search by inner product: ball trees over shards, branch and bound from the current k-th score."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import stash

#: Rows of a shard, queries whose bounds are worked out at once, rows of a leaf, about; bytes of query vectors that are broadcast at once.
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS, BLOCK_BYTES = 4096, 1024, 64, 16 << 20
_EXACT = float(1 << 53)


class BallTree:
    """Balls over integer vectors: halved at the median of the widest of a few directions, by rank, so equal vectors split too."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        self.rows, self.centre, self.radius, self.least, self.kids = [], [], [], [], []
        self.ids, self.vectors = ids, vectors
        self.exact = bool(len(vectors)) and float(np.abs(vectors.astype(np.float64)).max(initial=0)) < 2.0**26
        self.real = vectors.astype(np.float64)
        if len(ids):
            self._grow(np.arange(len(ids)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        part = self.real[rows]
        centre = part.mean(0)
        away = np.sqrt(((part - centre) ** 2).sum(1))
        at = len(self.rows)
        self.rows.append(rows)
        self.centre.append(centre)
        self.radius.append(float(away.max(initial=0)))
        self.least.append(int(self.ids[rows].min()))
        self.kids.append(())
        if len(rows) > leaf and self.radius[at] > 0:
            one = part[away.argmax()]
            two = part[((part - one) ** 2).sum(1).argmax()]
            order = np.argsort(part @ (two - one), kind="stable")
            half = len(rows) // 2
            self.kids[at] = (self._grow(rows[order[:half]], leaf), self._grow(rows[order[half:]], leaf))
        return at

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.centre), np.array(self.radius)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> list[int]:
        """Exact integers: in doubles while no sum can leave 53 bits, else in Python's."""
        if self.exact and float(np.abs(q.astype(np.float64)).max(initial=0)) * 2.0**26 * max(1, len(q)) < _EXACT:
            return (self.real[rows] @ q.astype(np.float64)).astype(np.int64).tolist()
        big = q.astype(object)
        return [int((v * big).sum()) if len(big) else 0 for v in self.vectors[rows].astype(object)]

    def search(self, q_id: int, q: np.ndarray, k: int, floor: int | None, bounds: np.ndarray) -> list[tuple[int, int]]:
        """The k best (score, id) but the query's own, none below `floor`, a score that k rows reach elsewhere.

        Nodes are opened by falling upper bound; the search ends when the best open bound is below the k-th score. A node
        whose bound ties with it is opened only if it may hold a smaller id.
        """
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        open_nodes = [(-bounds[0], 0)] if len(self.ids) else []
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if floor is not None and -bound < floor:
                break
            if len(best) == k and (-bound < best[0][0] or (np.floor(-bound) <= best[0][0] and self.least[node] > -best[0][1])):
                if -bound < best[0][0]:
                    break
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(open_nodes, (-bounds[kid], kid))
                continue
            rows = self.rows[node]
            for s, i in zip(self.scores(rows, q), self.ids[rows].tolist()):
                if i == q_id or (floor is not None and s < floor):
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return [(s, -i) for s, i in best]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query the upper bound of each node: q.c + |q| r, with room for rounding."""
        centre, radius = self.arrays()
        q = queries.astype(np.float64)
        dot = q @ centre.T
        reach = np.sqrt((q**2).sum(1))[:, None]
        size = np.sqrt((centre**2).sum(1))[None, :]
        return dot + reach * radius + 1e-9 * reach * (size + radius) + 1e-6


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id long, v array<long>) with floor(scale * x) of every component; rows whose id or vector is null, or holds null or a value that isn't finite, go.

    Components beyond a long are held at its ends.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = F.lit(9.2233720368547748e18)
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, top), -top)).cast("long"))
    return rows.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


class _Queries:
    """One block of queries by the length of their vectors, each with a floor: a score that k rows reach, if one is known."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray], floors: dict[int, int]) -> None:
        self.of: dict[int, tuple[list[int], np.ndarray]] = {}
        for d in {len(v) for v in vectors}:
            some = [i for i, v in enumerate(vectors) if len(v) == d]
            self.of[d] = ([ids[i] for i in some], np.stack([vectors[i] for i in some]))
        self.floors = floors


class _Search:
    """What a task knows: each query's k best so far. Each shard's search starts from the better of the floor and the k-th of them."""

    def __init__(self, queries: _Queries, k: int) -> None:
        self.queries, self.k = queries, k
        self.best: dict[int, list[tuple[int, int]]] = {}

    def shard(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        q_ids, q = self.queries.of.get(vectors.shape[1], ([], None))
        if not q_ids:
            return
        tree = BallTree(ids, vectors)
        for lo in range(0, len(q_ids), QUERY_ROWS):
            bounds = tree.bounds(q[lo : lo + QUERY_ROWS])
            for at, q_id in enumerate(q_ids[lo : lo + QUERY_ROWS]):
                held = self.best.setdefault(q_id, [])
                floor = self.queries.floors.get(q_id)
                if len(held) == self.k:
                    floor = held[-1][0] if floor is None else max(floor, held[-1][0])
                if floor is not None and bounds[at, 0] < floor:
                    continue
                if found := tree.search(q_id, q[lo + at], self.k, floor, bounds[at]):
                    held += [(s, -i) for s, i in found]
                    held.sort(reverse=True)
                    del held[self.k :]

    def rows(self) -> pa.RecordBatch:
        out = [(q, -i, max(-(2**63), min(2**63 - 1, s))) for q, held in self.best.items() for s, i in held]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])


def _search(candidates: DataFrame, queries: _Queries, k: int, shard_rows: int) -> DataFrame:
    """(query_id, vec_id, score): each task's k best of every query. A task's rows make a shard as soon as there are `shard_rows` of them; no candidate is shuffled."""
    sent = candidates.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(sent.value, k)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            ids, sizes, flat = (np.concatenate(x) for x in zip(*held))
            held.clear()
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                some = np.flatnonzero(sizes == d)
                search.shard(ids[some], flat[starts[some][:, None] + np.arange(d)])

        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                part = batch.slice(at, shard_rows)
                v = part.column(1)
                held.append((part.column(0).to_numpy(), v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), v.flatten().to_numpy()))
                if sum(len(x[0]) for x in held) >= shard_rows:
                    flush()
        if held:
            flush()
        yield search.rows()

    return candidates.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to smaller ids; exact.

    candidates and queries: (vec_id, v) as quantised() gives them. Queries are broadcast in blocks of `block_bytes` of
    vectors, one block as a rule. Candidates stay where they are read: each shard of `shard_rows` of them becomes a ball
    tree and meets the block. First a hash's share of the candidates, one shard's worth, is searched; the k-th score that a
    query finds there is its floor, and each shard of a task starts from the better of it and the k-th of the shards
    before, so only nodes whose bound reaches that are opened, and no shard whose root's doesn't. Tasks send k rows a
    query at most.

    Vectors of another length than the query's aren't compared with it. Rows that repeat an id are candidates each; a
    query is skipped where its own id stands, and repeated rows of a query count once, the first by vector. Scores beyond
    64 bits are held at its ends. Other columns aren't looked at. Empty tables give none; an empty vector scores 0.
    """
    queries = stash(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    size = queries.agg(F.sum(F.size("v") * 8 + 64).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // block_bytes))
    shares = max(1, candidates.count() // shard_rows)
    share = candidates.where(F.pmod(F.xxhash64(F.lit("f"), "vec_id"), F.lit(shares)) == 0)
    found = []
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64(F.lit("b"), "vec_id"), F.lit(blocks)) == b).toArrow()
        ids, vectors = got.column("vec_id").to_pylist(), [np.array(v, dtype=np.int64) for v in got.column("v").to_pylist()]
        low = _search(share if shares > 1 else share.limit(0), _Queries(ids, vectors, {}), k, shard_rows).groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), False), k, 1).alias("low"))
        floors = {r["query_id"]: r["low"][0] for r in low.where(F.size("low") == 1).collect() if r["low"][0] > -(2**63)}
        each = _search(candidates, _Queries(ids, vectors, floors), k, shard_rows)
        found.append(stash(each) if blocks > 1 else each)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
