"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into balanced parts by recursive bisection: a split at the
median of the main direction, then swaps of equal numbers that lower the edges cut. A small network learns to tell, from a
vector, which parts its neighbours lie in. It files every row under its most probable part and routes each query to its
most probable parts, up to the probability that held-out sample vectors need for the recall asked for: a query that the
network is sure of is sent to fewer. What is routed together is reranked in double precision.

A part's rows and its queries are cut into chunks, and each pair of chunks is a cell of its own, so no part, however large,
is one task's whole work. A cell keeps the nearest of its rows for each of its queries, so what is merged is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise

#: Rows that the parts and the network are fitted on, those with the least hashes of their ids.
SAMPLE = 8_192
#: The share of true neighbours that held-out vectors are to find.
RECALL = 0.93
#: At most so many parts, whatever the number of rows.
MAX_PARTS = 1_024
ROW_CHUNK, QUERY_CHUNK = 16_384, 4_096


def usable(vector: Column, size: int) -> Column:
    """Vectors that take part: of the size, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == size) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(x: np.ndarray, to: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Indices of the k rows of `to` with the largest inner products; own: row i of x is row i of `to` and doesn't count."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        scores = x[a : a + 1024] @ to.T
        if own:
            scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        out[a : a + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row; sizes differ by one at most for each bisection. parts is a power of two."""
    out = np.zeros(len(x), np.int64)
    both = [(np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel())]
    src, dst = np.concatenate([both[0][0], both[0][1]]), np.concatenate([both[0][1], both[0][0]])
    step = parts
    rng = np.random.default_rng(5)
    while step > 1:
        step //= 2
        for part in range(0, parts, 2 * step):
            rows = np.flatnonzero(out == part)
            if len(rows) < 2:
                continue
            centred = x[rows] - x[rows].mean(axis=0)
            way = rng.normal(size=x.shape[1])
            for _ in range(12):
                way = centred.T @ (centred @ way)
                way /= max(np.linalg.norm(way), 1e-300)
            side = np.zeros(len(x), bool)
            side[rows[np.argsort(centred @ way, kind="stable")[len(rows) // 2 :]]] = True
            inside = (out[src] == part) & (out[dst] == part)
            s, d = src[inside], dst[inside]
            for _ in range(8):
                gain = np.bincount(s, np.where(side[s] != side[d], 1.0, -1.0), len(x))
                low, high = rows[~side[rows]], rows[side[rows]]
                low, high = low[np.argsort(-gain[low], kind="stable")], high[np.argsort(-gain[high], kind="stable")]
                n = min(len(low), len(high))
                better = int(np.sum(gain[low[:n]] + gain[high[:n]] > 0))
                better = min(better, max(1, len(rows) // 16)) if better else 0
                if not better:
                    break
                side[low[:better]], side[high[:better]] = True, False
            out[rows[side[rows]]] += step
    return out


@dataclass
class Router:
    """A network of one hidden layer: part probabilities from a vector."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: np.ndarray
    mass: float = 0.0  # a part is asked while the more probable ones have no more probability than this

    @property
    def parts(self) -> int:
        return len(self.d)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.a + self.b, 0) @ self.c + self.d

    def order(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row all parts, most probable first, and the probability of those before each."""
        z = self.logits(x)
        order = np.argsort(-z, axis=1, kind="stable")
        share = np.exp(z - z.max(axis=1, keepdims=True))
        share = np.take_along_axis(share / share.sum(axis=1, keepdims=True), order, 1)
        return order, np.cumsum(share, axis=1) - share


def train_router(x: np.ndarray, goal: np.ndarray, hidden: int = 256, epochs: int = 12, batch: int = 256) -> Router:
    rng = np.random.default_rng(11)
    size, parts = x.shape[1], goal.shape[1]
    w = [rng.normal(size=(size, hidden)) * np.sqrt(2 / size), np.zeros(hidden), rng.normal(size=(hidden, parts)) * np.sqrt(2 / hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xb = x[rows]
            h = np.maximum(xb @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (z / z.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            dh = (dz @ w[2].T) * (h > 0)
            grads, t = [xb.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)], t + 1
            rate = 4e-3 * (1 - epoch / epochs) + 2e-4
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(*w)


def fit(x: np.ndarray, parts: int, k: int = 20, recall: float = RECALL, neighbours: int = 10) -> Router:
    """The router for a sample; its mass is the least that gives the recall, and a margin for the size of the sample, on an eighth of it that is held out."""
    scale = np.sqrt((x**2).sum(axis=1).mean())
    x = x / scale
    held, rest = x[: -(-len(x) // 8)], x[-(-len(x) // 8) :]
    if len(rest) < 2:
        held = rest = x
    k, neighbours = min(k, len(rest)), max(1, min(neighbours, len(rest) - 1))
    graph = nearest(rest, rest, neighbours, len(rest) > 1)
    part = balanced_parts(rest, graph, parts)
    goal = np.zeros((len(rest), parts))
    np.add.at(goal, (np.repeat(np.arange(len(rest)), neighbours), part[graph].ravel()), 0.5 / neighbours)
    goal[np.arange(len(rest)), part] += 0.5
    router = train_router(rest, goal)
    filed = router.logits(rest).argmax(axis=1)
    order, before = router.order(held)
    places = np.argsort(order, axis=1)
    need = np.sort(np.take_along_axis(before, np.take_along_axis(places, filed[nearest(held, rest, k, False)], 1), 1).ravel())
    wanted = min(1.0, recall + 0.25 / np.sqrt(len(held)))
    router.mass = float(need[min(len(need) - 1, int(np.ceil(wanted * len(need))))]) + 1e-12
    router.a = router.a / scale
    return router


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _top(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query, ties to smaller ids; scores are sums of products from the first component to the last."""
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(queries), 256):
        q, q_ids = queries[a : a + 256], query_ids[a : a + 256]
        scores = q @ rows.T
        scores[q_ids[:, None] == ids[None, :]] = -np.inf
        n = scores.shape[1]
        edge = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
        i, j = np.nonzero((scores >= (edge - slack)[:, None]) & (scores > -np.inf))
        exact = np.zeros(len(i))
        for d in range(q.shape[1]):
            exact = exact + q[i, d] * rows[j, d]
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(q)))
        keep = np.arange(len(i)) - first[i] < k
        out.append((q_ids[i[keep]], ids[j[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, recall: float = RECALL, sample: int = SAMPLE, parts: int | None = None, probes: int | None = None, row_chunk: int = ROW_CHUNK, query_chunk: int = QUERY_CHUNK
) -> DataFrame:
    """For each usable row whose id is divisible by every: query_id, rank, vec_id, score of its k nearest other rows.

    Nearness is the inner product. Null, zero, non-finite and odd-sized vectors (other than the commonest size) and rows
    without an id take no part. A query's own row is every row with its id; an id that repeats is one query, with the
    least of its vectors, while repeated rows are candidates each for itself. Other columns are not read. Tables of any size
    are searched the same way; probes asks so many parts for each query instead of those that the recall needs.
    """
    kind = "array<float>" if dict(vectors.dtypes).get(vector_col) == "array<float>" else "array<double>"  # floats travel as they are
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    sizes = source.groupBy(F.size("v").alias("size")).count().filter("size > 0").orderBy(F.desc("count"), "size").first()
    empty = source.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    size = int(sizes["size"])
    source = source.filter(usable(F.col("v"), size))
    some = source.select("v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toPandas()  # bounded by `sample`
    n = source.count()
    if not n:
        return empty
    x = np.array(some["v"].tolist(), np.float64).reshape(-1, size)
    parts = parts or int(min(MAX_PARTS, 2 ** max(0, round(np.log2(np.sqrt(n) / 2)))))
    router = fit(x, parts, k, recall)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.logits(_matrix(batch.column(1), size)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], names=["part", "vec_id", "v"])

    filed = materialise(source.mapInArrow(file, f"part int, vec_id long, v {kind}"), "ann-rows")
    held = dict(filed.groupBy("part").count().collect())  # a row for each part
    counts = np.array([held.get(p, 0) for p in range(router.parts)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, before = router.order(_matrix(batch.column(1), size))
            found = np.cumsum(counts[order], axis=1) - counts[order]
            near = before <= router.mass if probes is None else np.arange(router.parts)[None, :] < probes
            taken = near | (found < 4 * k)  # and on, where parts are almost empty
            i, j = np.nonzero(taken)
            rows = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(order[i, j].astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["part", "query_id", "q"])

    asked = source.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    routed = materialise(asked.select("vec_id", "v").mapInArrow(route, f"part int, query_id long, q {kind}"), "ann-queries")
    asks = dict(routed.groupBy("part").count().collect())
    grid = [(p, -(-int(counts[p]) // row_chunk), -(-asks.get(p, 0) // query_chunk)) for p in range(router.parts) if counts[p] and asks.get(p)]
    cells = F.broadcast(source.sparkSession.createDataFrame(grid or [(-1, 1, 1)], "part int, rows int, asks int"))  # a row for each part
    left = filed.join(cells, "part").select("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("rows")).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("a"), "vec_id", "v")
    right = routed.join(cells, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), F.pmod(F.xxhash64("query_id"), F.col("asks")).cast("int").alias("a"), "query_id", "q")

    def cell(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        found = _top(rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(np.float64), queries["query_id"].to_numpy(), np.stack(queries["q"].to_numpy()).astype(np.float64), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["part", "r", "a"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))  # at most k rows a cell
    return best.select("query_id", F.posexplode("best").alias("place", "b")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))


def op10_ann_search(vectors: DataFrame) -> DataFrame:
    return search(vectors)
