"""Embedding near-copies by iterative quantisation.

On at most `sample` vectors (those of the smallest hashes of vec_id) rotations of the centred principal axes are learned that
bring the vectors close to the corners of a cube, so that the signs make balanced bits. Substrings of the codes
are the keys of multi-index Hamming tables; vectors that share a key are compared by cosine on the original
vectors. Substring length grows with the number of vectors (about BUCKET rows a key), and the number of tables and of
rotations follows from it so that a pair at the threshold shares a key with probability RECALL. That share is measured on
pairs made from the sample, since a mean of all vectors widens the angle of the centred ones: tables are added until
it is reached, and where that takes more than TABLES, substrings get shorter.

Keys held by many vectors are split into blocks whose pairs are tasks of their own, so every link is counted and no
group is held whole; a pair found in several tables counts in the first. Only counts and the smallest linked id leave a task.
Defined cases: see `vectors`; vectors of different length don't link; a vector that takes no part has no links and
is its own component; repeated rows of a vec_id give one row; rows without vec_id none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgrid.llm import vectors as V
from taintgrid.llm.shared import blocked, components, roots, runs, sorted_groups
from taintgrid.session import checkpoint

THRESHOLD = 0.9
RECALL = 0.98
SAMPLE = 20_000
ROUNDS = 30
BUCKET = 256
TABLES = 64
PAIRS = 4000
SHORTEST, LONGEST = 7, 24
BLOCK = 512


@dataclass
class Coder:
    """Signs of (x - mean) @ axes, one column a bit, and the length and number of the tables' substrings."""

    mean: np.ndarray
    axes: np.ndarray
    length: int
    tables: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.axes[:, : self.length * self.tables] > 0).reshape(len(x), self.tables, self.length)
        return bits.astype(np.int64) @ (1 << np.arange(self.length))


def layout(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Length of a table's substring and number of tables. A bit differs with the angle over pi."""
    length = min(LONGEST, max(SHORTEST, round(math.log2(max(1, n) / BUCKET))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** length
    return length, 1 if same >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - same))


def rotations(y: np.ndarray, rounds: int = ROUNDS) -> Iterator[np.ndarray]:
    """Rotations by alternating the nearest corners and the best rotation onto them."""
    bits = y.shape[1]
    rng = np.random.default_rng(8)
    while True:
        turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        yield turn


def pairs_at(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and for each a vector at the threshold's cosine on the way to another of them (that one itself if nearer)."""
    rng = np.random.default_rng(9)
    i = rng.integers(0, len(x), PAIRS)
    x, other = x[i], x[(i + rng.integers(1, max(2, len(x)), PAIRS)) % len(x)]
    cosine = (x * other).sum(1, keepdims=True)
    away = other - cosine * x
    length = np.linalg.norm(away, axis=1, keepdims=True)
    made = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * away / np.maximum(length, 1e-300)
    return x, np.where(cosine >= threshold, other, np.where(length > 1e-9, made, x))


def learn(x: np.ndarray, n: int, threshold: float, recall: float) -> Coder:
    """Coder for n vectors like the sample's x, of whose pairs at the threshold at least the share recall meet in a key."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(0)
    axes = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1]  # principal axes, the widest first
    more, turned = rotations((x - mean) @ axes), []
    a, b = pairs_at(x, threshold)
    length, tables = layout(n, threshold, recall)
    while length > 0:
        while len(turned) * x.shape[1] < length * tables:
            turned.append(axes @ next(more))
        coder = Coder(mean, np.concatenate(turned, 1), length, tables)
        found = float((coder.keys(a) == coder.keys(b)).any(1).mean())
        if found >= recall:
            return coder
        one = 1 - (1 - found) ** (1 / tables)  # share of pairs that meet in one table
        tables = max(tables + 1, math.ceil(math.log(1 - recall) / math.log(1 - one))) if one > 0 else TABLES + 1
        if tables > TABLES:
            length -= 1
            bit = max(0.5, one ** (1 / (length + 1)))
            tables = min(TABLES, math.ceil(math.log(1 - recall) / math.log(1 - min(bit**length, recall))))
    return Coder(mean, axes, 0, 1)  # one key: all are compared


def _key_column(coder: Coder, dim: int):
    def keys(vec: pa.Array) -> pa.Array:
        x, size = V.scaled(V.matrix(vec, dim))
        return pa.array([k.astype(np.int32).tobytes() for k in coder.keys(x / size[:, None])], pa.binary())

    return F.arrow_udf(keys, "binary")


def _split(keys: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(k, np.int32) for k in keys.to_pylist()], pa.list_(pa.int32()))


def _links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for t in sorted_groups(batches, ["dim", "table", "key", "bi", "bj"]):
        cols = [t.column(c).to_numpy() for c in ("dim", "table", "key", "bi", "bj")]
        dim, table, _, bi, bj = cols
        bounds = runs(cols)
        ids, own, vec, keys = t.column("vec_id").to_numpy(), t.column("own").to_numpy(), t.column("vec").combine_chunks(), t.column("keys").combine_chunks()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            x, n = V.scaled(V.matrix(vec.slice(lo, hi - lo), int(dim[lo])))
            u = x / n[:, None]
            near = u @ u.T >= threshold - 1e-9
            near &= own[lo:hi, None] != own[None, lo:hi] if bi[lo] != bj[lo] else ~np.eye(hi - lo, dtype=bool)
            i, j = np.nonzero(np.triu(near))
            exact = V.cosine(x[i], n[i], x[j], n[j]) >= threshold
            i, j = i[exact], j[exact]
            if not len(i):
                continue
            code = np.frombuffer(b"".join(keys.slice(lo, hi - lo).to_pylist()), np.int32).reshape(hi - lo, -1)
            first = np.ones(len(i), bool)
            for earlier in range(int(table[lo])):
                first &= code[i, earlier] != code[j, earlier]
            count = np.bincount(np.concatenate([i[first], j[first]]), minlength=hi - lo)
            hit = np.unique(np.concatenate([i, j]))
            order = np.argsort(ids[lo:hi], kind="stable")
            rank = np.empty(hi - lo, np.int64)
            rank[order] = np.arange(hi - lo)
            least = order[roots(hi - lo, rank[i], rank[j])[rank[hit]]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][hit]), pa.array(count[hit]), pa.array(ids[lo:hi][least])], ["vec_id", "n", "least"])


def near_copies(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = checkpoint(V.usable(embeddings))
    every = V.one_each(embeddings).select("vec_id")
    found = None
    for dim, n in sorted((r.dim, r.n) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        own = rows.where(F.col("dim") == dim)
        few = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow()["vec"].combine_chunks()
        coder = learn(V.scaled(V.matrix(few, dim))[0], n, threshold, recall)

        coded = checkpoint(own.withColumn("keys", _key_column(coder, dim)(F.col("vec"))))
        places = coded.select("vec_id", F.posexplode(F.arrow_udf(_split, "array<int>")(F.col("keys"))).alias("table", "key"))
        size = places.groupBy("table", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = places.join(size, ["table", "key"]).join(coded, "vec_id")
        tasks = blocked(met, F.col("size") / BLOCK, F.col("vec_id")).select("dim", "table", "key", "bi", "bj", "own", "vec_id", "vec", "keys")
        tasks = tasks.repartition("table", "key", "bi", "bj").sortWithinPartitions("dim", "table", "key", "bi", "bj")
        part = tasks.mapInArrow(lambda b: _links(b, threshold), "vec_id bigint, n bigint, least bigint")
        found = part if found is None else found.union(part)
    if found is None:
        return every.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = checkpoint(found)
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    same = components(found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    out = every.join(links, "vec_id", "left").join(same, F.col("vec_id") == same["id"], "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
