"""Approximate nearest neighbours by inner product on robust-pruned directed graphs, one a shard.

Rows are dealt to shards of bounded memory by a hash of the id. A shard keeps its distinct vectors (a repeated vector
is one node with its smallest ids), adds a coordinate that turns the largest inner product into the smallest distance,
and builds its graph: greedy searches propose neighbours, relaxed distance pruning keeps diverse ones, and edges go
both ways. Each graph is built once and written to the checkpoint folder. Every query is searched with a beam in every
shard: the queries stream past a graph in blocks, a bounded number of them in a task; the shards' best are merged.

Building is linear in the rows. Searching is queries times shards, as each shard is asked: with a fixed share of the
rows as queries it grows with the square of the rows over the rows of a shard, so shards are as large as memory allows.

Null and zero vectors and those with null or non-finite components take no part, nor do null ids. Vectors are
compared with those of their own length. Ties go to the smaller id. Fewer candidates than k: all that are found.
Empty input: no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import col, cut, small_batches

DEGREE, BUILD_BEAM, ALPHA, BATCH = 32, 56, 1.2, 512


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `beam` nearest nodes met (-1 where fewer) and their squared distances."""
    n, q = len(points), len(queries)
    norm = np.einsum("ij,ij->i", points, points)
    own = np.einsum("ij,ij->i", queries, queries)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    open_ = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], open_[:, 0], seen[:, entry] = entry, True, True
    dist[:, 0] = own + norm[entry] - 2 * (queries @ points[entry])
    rows = np.arange(q)
    while len(rows):
        best = np.argmin(np.where(open_[rows], dist[rows], np.inf), axis=1)
        go = open_[rows, best]
        rows, best = rows[go], best[go]
        if not len(rows):
            break
        open_[rows, best] = False
        near = graph[ids[rows, best]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], np.where(near >= 0, near, entry)] = True
        d = own[rows, None] + norm[near] - 2 * np.einsum("brd,bd->br", points[near], queries[rows])
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_d = np.concatenate((dist[rows], d), axis=1)
        pick = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        take = lambda a, b: np.take_along_axis(np.concatenate((a, b), axis=1), pick, axis=1)
        ids[rows] = take(ids[rows], np.where(fresh, near, -1))
        open_[rows] = take(open_[rows], fresh)
        dist[rows] = np.take_along_axis(all_d, pick, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each node's candidates (-1: none): again and again the nearest, dropping those that it is nearer to, by alpha, than the node."""
    c = np.where(candidates == nodes[:, None], -1, candidates)
    c = np.sort(c, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    x = points[c]
    d = np.einsum("bcd,bcd->bc", x - points[nodes][:, None], x - points[nodes][:, None])
    d[c < 0] = np.inf
    sq = np.einsum("bcd,bcd->bc", x, x)
    between = sq[:, :, None] + sq[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1, np.int64)
    row = np.arange(len(nodes))
    alive = d.copy()
    for i in range(degree):
        best = np.argmin(alive, axis=1)
        ok = np.isfinite(alive[row, best])
        if not ok.any():
            break
        out[ok, i] = c[row[ok], best[ok]]
        alive[alpha * between[row, best] <= d] = np.inf
        alive[row, best] = np.inf
    return out


def build_graph(points: np.ndarray, seed: int, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    n, rng = len(points), np.random.default_rng(seed)
    entry = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    graph = np.full((n, degree), -1, np.int64)
    if n > 1:
        start = rng.integers(0, n, (n, min(degree, 8)))
        graph[:, : start.shape[1]] = np.where(start == np.arange(n)[:, None], (start + 1) % n, start)
        graph = robust_prune(points, np.arange(n), graph, degree, 1e9) if n <= degree else _distinct(graph)
    order = rng.permutation(n)
    for at in range(0, n, BATCH):
        nodes = order[at : at + BATCH]
        found, _ = beam_search(points, graph, entry, points[nodes], min(beam, max(2, n)))
        graph[nodes] = robust_prune(points, nodes, np.concatenate((found, graph[nodes]), axis=1), degree, alpha)
        src, dst = np.repeat(nodes, degree), graph[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(to), BATCH):
            t, f, k = to[lo : lo + BATCH], first[lo : lo + BATCH], count[lo : lo + BATCH]
            width = int(k.max())
            new = np.where(np.arange(width) < k[:, None], src[np.minimum(f[:, None] + np.arange(width), len(src) - 1)], -1)
            if width > 3 * degree:  # the nearest of very many
                d = ((points[new] - points[t][:, None]) ** 2).sum(2)
                d[new < 0] = np.inf
                new = np.take_along_axis(new, np.argpartition(d, 3 * degree, axis=1)[:, : 3 * degree], axis=1)
            graph[t] = _joined(points, t, np.concatenate((graph[t], new), axis=1), degree, alpha)
    return graph, entry


def _joined(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Each node's candidates where they find room, else pruned."""
    c = _distinct(np.where(candidates == nodes[:, None], -1, candidates))
    c = np.sort(c, axis=1)[:, ::-1]
    over = np.flatnonzero(c[:, degree] >= 0) if c.shape[1] > degree else np.empty(0, np.int64)
    out = c[:, :degree].copy()
    if len(over):
        out[over] = robust_prune(points, nodes[over], c[over], degree, alpha)
    return out


def _distinct(graph: np.ndarray) -> np.ndarray:
    g = np.sort(graph, axis=1)[:, ::-1].copy()
    g[:, 1:][g[:, 1:] == g[:, :-1]] = -1
    return g


@dataclass
class Shard:
    """A built shard: ids ascending, its distinct vectors as nodes, and which rows each node stands for."""

    ids: np.ndarray
    by: np.ndarray  # rows, by node and within it by id
    start: np.ndarray  # of each node's rows in `by`
    nodes: np.ndarray
    points: np.ndarray
    graph: np.ndarray
    entry: int

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, seed: int) -> Shard:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        nodes, inverse, count = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
        exact = nodes.astype(np.float64)
        length = np.einsum("ij,ij->i", exact, exact)
        points = np.concatenate((exact, np.sqrt(np.maximum(length.max() - length, 0))[:, None]), axis=1).astype(np.float32)
        graph, entry = build_graph(points, seed)
        return Shard(ids, np.argsort(inverse.ravel(), kind="stable"), np.concatenate(([0], np.cumsum(count))), nodes, points, graph.astype(np.int32), entry)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> list[tuple[int, int, float]]:
        """(query, id, score) of each query's k best here, its own id left out."""
        out = []
        for at in range(0, len(query_ids), BATCH):
            q, qi = queries[at : at + BATCH], query_ids[at : at + BATCH].tolist()
            padded = np.concatenate((q, np.zeros((len(q), 1))), axis=1).astype(np.float32)
            found, _ = beam_search(self.points, self.graph, self.entry, padded, min(beam, max(2, len(self.nodes))))
            for i in range(len(q)):
                node = found[i][found[i] >= 0]
                score = (self.nodes[node].astype(np.float64) * q[i].astype(np.float64)).sum(1)
                best = np.argsort(-score, kind="stable")[: k + 1]  # nodes: as many rows at least
                last = score[best[-1]]
                held = []
                for n, s in zip(node[score >= last].tolist(), score[score >= last].tolist()):
                    rows = self.ids[self.by[self.start[n] : min(self.start[n + 1], self.start[n] + k + 1)]].tolist()
                    held += [(-s, v) for v in rows if v != qi[i]]
                held.sort()
                out += [(qi[i], v, -s) for s, v in held[:k]]
        return out


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, beam: int = 224, shard_bytes: int = 24 << 20, block_queries: int = 512, task_queries: int = 50_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` to each row of `queries`, without the row of its own id."""

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v")
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(col(id_col).cast("long").alias("id"), col(vector_col).alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))

    rows, asked = usable(vectors), usable(queries)
    size = rows.agg(F.sum((F.col("dim") * 8 + 4 * DEGREE + 24).cast("long")), F.count("*")).first()
    n_shards = max(1, -(-(size[0] or 0) // shard_bytes))
    n_asked = asked.count()
    n_tasks = max(1, -(-n_asked // task_queries))  # of a shard
    n_blocks = max(1, -(-n_asked // (n_tasks * block_queries)))  # of a task

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.build(pdf.id.to_numpy(), np.stack(pdf.v.to_numpy()), int(pdf.shard.iloc[0]))
        return pd.DataFrame({"dim": [int(pdf.dim.iloc[0])], "shard": [int(pdf.shard.iloc[0])], "payload": [pickle.dumps(shard, protocol=5)]})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [int(pdf.dim.iloc[0])], "task": [int(pdf.task.iloc[0])], "payload": [pickle.dumps((pdf.id.to_numpy(), np.stack(pdf.v.to_numpy())), protocol=5)]})

    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    built = cut(rows.withColumn("shard", deal(42, n_shards)).groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, payload binary"))
    asked = asked.withColumns({"task": deal(1, n_tasks), "block": deal(2, n_blocks)})
    blocks = cut(asked.groupBy("dim", "task", "block").applyInPandas(block, "dim int, task int, payload binary"))
    series = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = ("dim", "shard", "task", "kind", "payload")
    met = built.withColumns({"kind": F.lit(0), "task": series(n_tasks)}).select(*names).unionByName(blocks.withColumns({"kind": F.lit(1), "shard": series(n_shards)}).select(*names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shard = None
        for b in batches:
            for *key, kind, payload in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    at, shard = key, pickle.loads(payload)
                elif key == at:  # else no row has that many components, or none here
                    found = shard.search(*pickle.loads(payload), k, beam)
                    q, v, s = zip(*found) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    small_batches(rows, 16)  # a row is a graph or a block of queries
    best = cut(met.repartition(F.xxhash64("dim", "shard", "task")).sortWithinPartitions("dim", "shard", "task", "kind").mapInArrow(run, "query_id long, vec_id long, score double"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
