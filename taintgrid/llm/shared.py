"""Helpers the operators of this folder share: tables, groups from a sorted stream, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgrid.session import checkpoint

BROADCAST_BYTES = 32 << 20  # a side known to be smaller may be sent to all executors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fingerprint(text: str = "text"):
    """128 bits of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast only if its counted rows stay under BROADCAST_BYTES; Spark shuffles it otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups from batches in which equal keys are adjacent; a group may cross batches.

    At any time a batch and the group that is still open are held, so a group must be bounded by its maker.
    """
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int):
        return tuple(batch.column(k)[i].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        same = np.ones(batch.num_rows, bool)
        same[0] = False
        for k in keys:
            col = batch.column(k).to_numpy(zero_copy_only=False)
            same[1:] &= col[1:] == col[:-1]
        cut = int(np.flatnonzero(~same)[-1])  # where the last group begins
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """Bounds of the runs of equal rows, with the end: n + 1 positions for n runs."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over edges a-b, by whole-array label passing."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def blocked(df: DataFrame, blocks, of) -> DataFrame:
    """Give each row the block pairs (bi <= bj) of its group that it takes part in, as columns bi, bj, own.

    A group falls into `blocks` parts by a hash of `of`; each pair of blocks becomes a task's group of its own,
    so what one task holds is bounded and no group is held whole. own: the row's block.
    """
    return (
        df.withColumn("_n", F.greatest(F.ceil(blocks).cast("int"), F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64(of), F.col("_n")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("bi", F.least("own", "_other"))
        .withColumn("bj", F.greatest("own", "_other"))
        .drop("_n", "_other")
    )


def components(edges: DataFrame, log: Callable[[str], None] | None = None) -> DataFrame:
    """(id, root) of every node of the undirected edges (a, b): root is the smallest id connected to it.

    Alternating large-star and small-star steps: each keeps one row per edge at most, needs the smallest
    neighbour of a node only (a partial aggregate), and joins on plain equality, so hot nodes are split by
    Spark's skew join. Ends when the edges are stars; edges with a null end and loops are left out.
    """
    e = checkpoint(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    while True:
        n, nodes = e.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        if log:
            log(f"components: {n} edges, {nodes} children")
        if n == nodes and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = checkpoint(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpoint(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
