"""Approximate nearest neighbours by collision counting.

Vectors of length one are projected on random directions; each projection is a sorted array. A query opens a window
around its own value in every array and widens all of them step by step (virtual rehashing). A vector that lies in the
windows of a share of the arrays is verified by its exact cosine. A query is answered when the windows are so wide that a
vector as near as its k-th best would have been counted often enough with probability RECALL; with fewer than k found, every
vector of the block is verified.

Vectors and queries fall into blocks by a hash; each pair of a vector block and a query block is one task's group, which
gives k rows per query; these are merged per query. So memory is bounded by the blocks, and the work is the stated query set
against all rows. Defined cases: see `vectors`; vectors meet only queries of their own length; the k-th place
goes to the smaller vec_id on equal cosines; fewer candidates than k give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.llm import vectors as V
from taintgrid.llm.shared import runs, sorted_groups
from taintgrid.session import checkpoint, top_n

K = 5
ARRAYS = 64
SHARE = 0.8  # of the arrays in whose windows a vector must lie
RECALL = 0.98
FIRST, WIDER = 0.6, 1.4  # half-width of the first windows, and the factor of each step
BLOCK, QUERIES = 4096, 1024


def reach(arrays: int, least: int, recall: float) -> float:
    """Half-width over distance at which a vector of that distance is counted `least` times with probability recall."""
    def enough(z: float) -> float:
        p = math.erf(z / math.sqrt(2))
        return sum(math.comb(arrays, i) * p**i * (1 - p) ** (arrays - i) for i in range(least, arrays + 1))

    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) >= recall else (middle, high)
    return high


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, arrays: int = ARRAYS, share: float = SHARE, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the vector, cosine) of the k nearest of a block for each query."""
    (x, xn), (q, qn) = V.scaled(x), V.scaled(q)
    axes = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], arrays))
    values, own = (x / xn[:, None]) @ axes, (q / qn[:, None]) @ axes
    order = np.argsort(values, 0, kind="stable").T
    lines = np.take_along_axis(values, order.T, 0).T.copy()
    least = math.ceil(arrays * share)
    factor = reach(arrays, least, recall)
    flat, shift = order.reshape(-1), np.arange(arrays) * len(ids)
    n_steps = max(1, math.ceil(math.log(2 * factor / FIRST, WIDER)) + 1)
    width = np.append(FIRST * WIDER ** np.arange(n_steps), np.inf)  # the last step has all vectors, for queries with fewer than k
    n_steps += 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # for each array all queries' window ends at once
    edges = np.stack([np.searchsorted(lines[j], np.concatenate([own[:, j, None] - width, own[:, j, None] + width], 1)) for j in range(arrays)], 1)
    count = np.empty(len(ids), np.int64)
    for i in range(len(query_ids)):
        lo, hi = edges[i, :, :n_steps], edges[i, :, n_steps:]
        count[:] = 0
        seen = ids == query_ids[i]
        found, score = np.zeros(0, np.int64), np.zeros(0)
        left = right = lo[:, 0]
        for step in range(n_steps):
            new = [flat[a:b] for a, b in zip((shift + lo[:, step]).tolist(), (shift + left).tolist(), strict=True) if a < b]
            new += [flat[a:b] for a, b in zip((shift + right).tolist(), (shift + hi[:, step]).tolist(), strict=True) if a < b]
            left, right = lo[:, step], hi[:, step]
            if new:
                count += np.bincount(np.concatenate(new), minlength=len(ids))
            fresh = np.flatnonzero((count >= least) & ~seen)
            seen[fresh] = True
            if len(fresh):
                found = np.concatenate([found, fresh])
                score = np.concatenate([score, V.cosine(x[fresh], xn[fresh], np.broadcast_to(q[i], (len(fresh), q.shape[1])), qn[i])])
                best = np.lexsort((ids[found], -score))[:k]
                found, score = found[best], score[best]
            if len(found) == k and width[step] >= factor * math.sqrt(max(0.0, 2 - 2 * score[-1])):
                break
        out.append((np.full(len(found), i), found, score))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _search(batches: Iterator[pa.RecordBatch], k: int, settings: dict) -> Iterator[pa.RecordBatch]:
    for t in sorted_groups(batches, ["dim", "block", "part"]):
        dim, block, part, query = (t.column(c).to_numpy() for c in ("dim", "block", "part", "query"))
        bounds = runs([dim, block, part])
        ids, vec = t.column("vec_id").to_numpy(), t.column("vec").combine_chunks()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            x, asks = V.matrix(vec.slice(lo, hi - lo), int(dim[lo])), query[lo:hi]
            if asks.all() or not asks.any():
                continue
            a, b = ids[lo:hi][asks], ids[lo:hi][~asks]
            i, j, score = search(b, x[~asks], a, x[asks], k, **settings)
            yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j]), pa.array(score)], ["query_id", "vec_id", "score"])


def neighbours(embeddings: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, queries: int = QUERIES, **settings) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row for which is_query holds."""
    rows = checkpoint(V.usable(embeddings).withColumn("asks", F.coalesce(is_query, F.lit(False))))
    n, n_asks = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, parts = max(1, math.ceil(n / block)), max(1, math.ceil(n_asks / queries))
    place = lambda of, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(of)).cast("int")
    data = rows.select("dim", "vec_id", "vec", place(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("query"))
    asks = rows.where("asks").select("dim", "vec_id", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), place(parts, 2).alias("part"), F.lit(True).alias("query"))
    met = data.union(asks).repartition("dim", "block", "part").sortWithinPartitions("dim", "block", "part")
    found = met.mapInArrow(lambda b: _search(b, k, settings), "query_id bigint, vec_id bigint, score double")
    best = top_n(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, "rank")
    return best.select("query_id", "rank", "vec_id", "score")
