"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts go, largest first, into the bin with the tightest remaining capacity that holds them, found
in a balanced tree of remaining capacities. For a fixed number of shards the capacity is the smallest for
which the groups fit into them, found by bisection from the mean load up; a group larger than the mean of what is left gets
a shard of its own first, so one hot text does not set the others' size. Law `bytes`: shards of near equal size.

Groups are packed by size class, not one by one: sizes under EXACT are classes of their own, larger ones fall into
STEPS classes per doubling, so the driver sees a table of bounded size (EXACT + STEPS per doubling rows), whatever the number
of groups; the groups above 1 / FINE of the mean load, at most shards * FINE, are packed one by one. Within a class
groups are numbered by their fingerprint, and a class's runs of numbers go to their bins. Numbers and slots come from
range-sorted partitions with offsets, so no class and no shard is sorted in one task.

Defined cases: a null text has no bytes and is one group with the empty text's rows of its kind apart (null is not
empty); a null doc_id is kept and sorts first; repeated rows get a slot each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgrid.session import checkpoint, ranked

SHARDS = 40
OVERHEAD = 16
EXACT = 1 << 14
STEPS = 64
FINE = 64


class Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key: tuple[float, int]):
        self.key, self.level, self.left, self.right = key, 1, None, None


def _skew(t: Node) -> Node:
    if t.left is not None and t.left.level == t.level:
        low = t.left
        t.left, low.right = low.right, t
        return low
    return t


def _split(t: Node) -> Node:
    if t.right is not None and t.right.right is not None and t.right.right.level == t.level:
        high = t.right
        t.right, high.left = high.left, t
        high.level += 1
        return high
    return t


class Bins:
    """Bins by (remaining capacity, number) in an AA tree, a balanced binary search tree."""

    def __init__(self) -> None:
        self.root: Node | None = None

    def put(self, key: tuple[float, int]) -> None:
        def into(t: Node | None) -> Node:
            if t is None:
                return Node(key)
            if key < t.key:
                t.left = into(t.left)
            else:
                t.right = into(t.right)
            return _split(_skew(t))

        self.root = into(self.root)

    def take(self, size: float) -> tuple[float, int] | None:
        """Remove and return the tightest bin that holds size."""
        found, t = None, self.root
        while t is not None:
            if t.key[0] >= size:
                found, t = t.key, t.left
            else:
                t = t.right
        if found is not None:
            self.root = self._without(self.root, found)
        return found

    def _without(self, t: Node | None, key: tuple[float, int]) -> Node | None:
        if t is None:
            return None
        if key < t.key:
            t.left = self._without(t.left, key)
        elif key > t.key:
            t.right = self._without(t.right, key)
        elif t.left is None or t.right is None:
            return t.right if t.left is None else t.left
        else:
            low = t.right
            while low.left is not None:
                low = low.left
            t.key, t.right = low.key, self._without(t.right, low.key)
        least = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
        if least < t.level:
            t.level = least
            if t.right is not None and t.right.level > least:
                t.right.level = least
        t = _skew(t)
        if t.right is not None:
            t.right = _skew(t.right)
            if t.right.right is not None:
                t.right.right = _skew(t.right.right)
        t = _split(t)
        if t.right is not None:
            t.right = _split(t.right)
        return t


@dataclass
class Run:
    """Groups number first to last - 1 of a class go to a bin."""

    kind: int
    first: int
    last: int
    bin: int


def pack(classes: list[tuple[int, float, int]], capacity: float, bins: int | None = None) -> tuple[list[Run], int] | None:
    """Best fit decreasing of (class, size, count), largest size first; runs and number of bins, None if more than `bins` are needed.

    Equal groups that follow each other go to the same bin while they fit, as best fit would place them one by one:
    the bin just used is the tightest as long as it holds another.
    """
    tree, runs, used = Bins(), [], 0
    for kind, size, count in classes:
        first = 0
        while first < count:
            found = tree.take(size)
            if found is None:
                if bins is not None and used == bins:
                    return None
                found, used = (max(capacity, size), used), used + 1
            room, at = found
            n = count - first if size <= 0 else max(1, min(count - first, int(room // size)))
            runs.append(Run(kind, first, first + n, at))
            tree.put((room - n * size, at))
            first += n
    return runs, used


def plan(classes: list[tuple[int, float, int]], shards: int) -> list[Run]:
    """Runs of the classes (class, mean size, count) over a fixed number of shards, near equal in size."""
    classes = sorted(classes, key=lambda c: (-c[1], c[0]))
    total, left = sum(s * n for _, s, n in classes), shards
    alone: list[Run] = []
    rest: list[tuple[int, float, int, int]] = []  # with the first number left
    for kind, size, count in classes:
        n = 0
        while n < count and left > 1 and size > total / left:  # a group over the mean of what is left
            alone.append(Run(kind, n, n + 1, len(alone)))
            total, left, n = total - size, left - 1, n + 1
        if n < count:
            rest.append((kind, size, count - n, n))
    shift = {kind: n for kind, _, _, n in rest}
    items = [(kind, size, count) for kind, size, count, _ in rest]
    low = total / left if left else 0.0
    high = low + max((s for _, s, _ in items), default=0.0)
    best = pack(items, high, left)
    while best is None:
        high *= 1.05
        best = pack(items, high, left)
    for _ in range(24):
        middle = (low + high) / 2
        found = pack(items, middle, left)
        if found is None:
            low = middle
        else:
            best, high = found, middle
        if high - low <= 1e-5 * high:
            break
    return alone + [Run(r.kind, r.first + shift[r.kind], r.last + shift[r.kind], r.bin + len(alone)) for r in best[0]]


def assign(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot (from 0 in each shard, by doc_id)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + overhead
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.md5(text), F.when(F.col("text").isNull(), "-").otherwise("")).alias("key"))
    rows = checkpoint(rows)
    groups = checkpoint(rows.groupBy("key").agg(F.sum("size").alias("load")))
    total, n = groups.agg(F.sum("load"), F.count(F.lit(1))).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    large = max(total / shards / FINE, EXACT)
    step = (F.floor(F.log2("load") * STEPS) + EXACT).cast("bigint")
    kind = F.when(F.col("load") >= large, -F.col("load")).when(F.col("load") < EXACT, F.col("load")).otherwise(step)
    classed = groups.withColumn("kind", kind)
    table = [(r.kind, r.load / r.n, r.n) for r in classed.groupBy("kind").agg(F.sum("load").alias("load"), F.count(F.lit(1)).alias("n")).collect()]
    runs = docs.sparkSession.createDataFrame([(r.kind, r.first, r.last, r.bin) for r in plan(table, shards)], "kind bigint, first bigint, last bigint, shard int")
    numbered = ranked(classed, ["kind"], ["key"], "number")
    # runs of a class are few; a class and its runs meet by class and are told apart by the number
    placed = numbered.join(F.broadcast(runs), (numbered["kind"] == runs["kind"]) & (F.col("number") > F.col("first")) & (F.col("number") <= F.col("last"))).select("key", "shard")
    out = rows.join(checkpoint(placed), "key").withColumn("_id", F.xxhash64("key"))
    slots = ranked(out.withColumn("_tie", F.monotonically_increasing_id()), ["shard"], [F.col("doc_id").asc_nulls_first(), F.col("_tie")], "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))
