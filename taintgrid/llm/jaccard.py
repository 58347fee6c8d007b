"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each different text gets a signature of trees x depth minimum hashes of its word runs. A tree's label is a
sorted prefix trie over `depth` hashes: the join starts at whole labels and shortens the matched prefix until
a pair at the threshold is met with the target recall, 1 - (1 - t**d)**trees. Rows that share a prefix and
agree in enough of the whole signature become candidates; the candidates' groups are compared exactly.

Copies of a text are one class from the start. Groups are compared in blocks, so a group of any size is
counted whole without listing its pairs: a task gives one row per text (links, smallest linked text).

Defined cases: a null text counts as empty; a text without words has no word runs and links only with its
exact copies; a text of fewer than n words has one run of all its words; repeated rows are copies; a null
doc_id takes part and never names a class if another row of the class has an id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgrid.llm import words as W
from taintgrid.llm.shared import blocked, components, fingerprint, roots, runs, sized, sorted_groups
from taintgrid.session import checkpoint

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6
RECALL = 0.9999
# A pair at the threshold whose share of equal hashes falls this far below it is lost; at 120 hashes that is 5.5 deviations.
SLACK = 0.2
BLOCK = 512
BLOCK_BYTES = 4 << 20
_SEED = np.random.default_rng(5).integers(0, 1 << 64, (2, 1024), dtype=np.uint64) | np.uint64(1)


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is met by some tree with the target recall."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {threshold}")


def signatures(texts: pa.Array, n: int, size: int) -> pa.Array:
    """size 16-bit minimum hashes of each text as bytes; null for a text without words."""
    out: list[bytes | None] = []
    for _, data, offsets in W.pieces(texts):
        starts, ends, counts = W.spans(data, offsets)
        runs_, own = W.grams(W.hashes(data, starts, ends), counts, n)
        full = np.flatnonzero(own)
        least = np.zeros((len(own), size), np.uint16)
        if len(full):
            at = (np.cumsum(own) - own)[full]
            for k in range(size):
                low = np.minimum.reduceat((runs_ ^ _SEED[0, k]) * _SEED[1, k], at)
                least[full, k] = (W.mix(low) >> np.uint64(48)).astype(np.uint16)
        out += [least[i].tobytes() if own[i] else None for i in range(len(own))]
    return pa.array(out, pa.binary())


def text_classes(docs: DataFrame, n: int, size: int) -> DataFrame:
    """One row per different text: fp, doc_id (the smallest), copies, at_least (rows with that id), sig."""
    sign = F.arrow_udf(lambda t: signatures(t, n, size), "binary")
    rows = docs.select("doc_id", fingerprint().alias("fp"), sign(F.col("text")).alias("sig"))
    one = rows.groupBy("fp", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"))
    return one.groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), F.sum("n").alias("copies"),
        F.min_by("n", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))).alias("at_least"), F.first("sig").alias("sig"))


def _prefixes(sig: pa.Array, trees: int, depth: int, length: int) -> pa.Array:
    """The first `length` hashes of each tree's label as one 64-bit number."""
    rows = np.frombuffer(b"".join(sig.to_pylist()), np.uint16).reshape(len(sig), trees, depth)[:, :, :length]
    key = np.full(rows.shape[:2], 1, np.uint64)
    for k in range(length):
        key = W.mix(key * np.uint64(65537) + rows[:, :, k])
    flat = pa.array(key.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) * trees + 1, trees, dtype=np.int32)), flat)


def _join_trie(sig: np.ndarray, own: np.ndarray, cross: bool, tree: int, depth: int, length: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the rows of one prefix group whose signatures agree in `least` of the hashes.

    Walks the trie from whole labels to the group's prefix: rows of a longer shared prefix are joined to the
    first of them; at the shortest prefix each row outside the largest part is held against all others, so every
    agreeing pair ends in one part while a large group of near copies costs its rows, not its pairs.
    """
    label = sig[:, tree * depth : (tree + 1) * depth]
    order = np.lexsort(label.T[::-1])
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    part = np.arange(len(sig))
    for d in range(depth, length, -1):
        bounds = runs([label[order, k] for k in range(d)])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo > 1:
                rows = order[lo:hi]
                good = rows[1:][(sig[rows[1:]] == sig[rows[0]]).mean(1) >= least]
                a.append(np.full(len(good), rows[0]))
                b.append(good)
        if a:
            part = roots(len(sig), np.concatenate(a), np.concatenate(b))
    names, sizes = np.unique(part, return_counts=True)
    for i in np.flatnonzero(part != names[np.argmax(sizes)]):
        other = np.flatnonzero(part != part[i])
        if cross:
            other = other[own[other] != own[i]]
        good = other[(sig[other] == sig[i]).mean(1) >= least]
        a.append(np.full(len(good), i))
        b.append(good)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    part = roots(len(sig), a, b)
    at = np.flatnonzero(part != np.arange(len(sig)))
    return at, part[at]


def _candidates(batches: Iterator[pa.RecordBatch], trees: int, depth: int, length: int, least: float) -> Iterator[pa.RecordBatch]:
    for t in sorted_groups(batches, ["tree", "prefix", "bi", "bj"]):
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, trees * depth)
        tree, prefix, bi, bj, own = (t.column(c).to_numpy() for c in ("tree", "prefix", "bi", "bj", "own"))
        bounds = runs([tree, prefix, bi, bj])
        size = np.diff(bounds)
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for n in range(2, 9):  # all small groups of one size at a time
            lo = bounds[:-1][size == n]
            for i in range(n if len(lo) else 0):
                for j in range(i):
                    for part in np.array_split(lo, max(1, len(lo) // 50_000)):
                        good = part[(sig[part + i] == sig[part + j]).mean(1) >= least]
                        a.append(good + i)
                        b.append(good + j)
        for lo, hi in zip(bounds[:-1][size > 8], bounds[1:][size > 8], strict=True):
            x, y = _join_trie(sig[lo:hi], own[lo:hi], bi[lo] != bj[lo], int(tree[lo]), depth, length, least)
            a.append(x + lo)
            b.append(y + lo)
        if a:
            fp = t.column("fp").combine_chunks()
            yield pa.RecordBatch.from_arrays([fp.take(pa.array(np.concatenate(x))) for x in (a, b)], ["a", "b"])


def candidates(classes: DataFrame, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """Edges (a, b) of fingerprints that connect every candidate pair, not necessarily directly."""
    length = prefix_length(threshold, trees, depth, recall)
    least = threshold - SLACK
    cut = F.arrow_udf(lambda s: _prefixes(s, trees, depth, length), "array<bigint>")
    keys = (
        classes.where("sig is not null").select("fp", F.posexplode(cut(F.col("sig"))).alias("tree", "prefix"))
    )
    shared = keys.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = checkpoint(keys.join(shared, ["tree", "prefix"]))
    rows = blocked(met.join(classes.select("fp", "sig"), "fp"), F.col("size") / BLOCK, F.col("fp"))
    near = rows.select("tree", "prefix", "bi", "bj", "own", "fp", "sig").repartition("tree", "prefix", "bi", "bj")
    return near.sortWithinPartitions("tree", "prefix", "bi", "bj").mapInArrow(
        lambda x: _candidates(x, trees, depth, length, least), "a binary, b binary")


def _linked(sets: list[np.ndarray], threshold: float, own: np.ndarray, cross: bool) -> np.ndarray:
    """Which pairs of the sets (sorted, without repeats) have a Jaccard similarity of threshold or more."""
    n, size = len(sets), np.array([len(s) for s in sets])
    both = np.zeros((n, n), np.float64)
    if n <= 3:
        for i in range(n):
            for j in range(i):
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        value, row = np.concatenate(sets), np.repeat(np.arange(n), size)
        order = np.argsort(value, kind="stable")
        value, row = value[order], row[order]
        bounds = runs([value])
        many = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
        column = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[many]
        column, row = np.unique(column, return_inverse=True)[1], row[many]
        step = max(256, (8 << 20) // n)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            i, j = np.searchsorted(column, (lo, lo + step))
            holds = np.zeros((n, step), np.float32)
            holds[row[i:j], column[i:j] - lo] = 1
            both += holds @ holds.T
    union = size[:, None] + size[None, :] - both
    out = (both / np.maximum(union, 1) >= threshold) & (union > 0)
    np.fill_diagonal(out, False)
    return out & (own[:, None] != own[None, :]) if cross else out


def _verify(batches: Iterator[pa.RecordBatch], n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for t in sorted_groups(batches, ["root", "bi", "bj"]):
        bounds = runs([t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("root", "bi", "bj")])
        fps, copies, own = t.column("fp").combine_chunks(), t.column("copies").to_numpy(), t.column("own").to_numpy()
        bi, bj, text = t.column("bi").to_numpy(), t.column("bj").to_numpy(), t.column("text").combine_chunks()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            sets: list[np.ndarray] = []
            for _, data, offsets in W.pieces(text.slice(lo, hi - lo)):
                starts, ends, counts = W.spans(data, offsets)
                grams, size = W.grams(W.hashes(data, starts, ends), counts, n)
                sets += [np.unique(x) for x in np.split(grams, np.cumsum(size)[:-1])]
            linked = _linked(sets, threshold, own[lo:hi], bi[lo] != bj[lo])
            hit = np.flatnonzero(linked.any(1))
            if len(hit):
                x, y = np.nonzero(linked)
                names = np.array(fps.slice(lo, hi - lo).to_pylist(), object)
                order = np.argsort(names)  # the smallest fingerprint names the part
                rank = np.empty(len(names), np.int64)
                rank[order] = np.arange(len(names))
                least = order[roots(len(names), rank[x], rank[y])[rank[hit]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[hit], pa.binary()), pa.array((linked[hit] @ copies[lo:hi]).astype(np.int64)),
                     pa.array(linked[hit].sum(1).astype(np.int64)), pa.array(names[least], pa.binary())],
                    ["fp", "links", "texts", "least"])


def jaccard_classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """One row per different text: fp, doc_id, copies, at_least, keeper, class_id, n_links, n_texts.

    class_id: smallest doc_id of all rows connected by copies and links; keeper: the fp whose row of that id
    stays; n_links: other rows linked directly, copies included; n_texts: other texts linked directly.
    """
    classes = checkpoint(text_classes(docs, n, trees * depth))
    near = candidates(classes, threshold, trees, depth, recall)
    parts = checkpoint(components(near).select(F.col("id").alias("fp"), "root").join(classes.select("fp", "copies"), "fp"))
    rows = docs.select("text", fingerprint().alias("fp")).join(sized(parts, 64), "fp")
    texts = checkpoint(rows.groupBy("fp").agg(F.first("text").alias("text"), F.first("root").alias("root"), F.first("copies").alias("copies")))
    size = texts.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum(F.octet_length("text")).alias("bytes"))
    tasks = blocked(texts.join(size, "root"), F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES), F.col("fp"))
    tasks = tasks.select("root", "bi", "bj", "own", "fp", "copies", "text").repartition("root", "bi", "bj")
    found = tasks.sortWithinPartitions("root", "bi", "bj").mapInArrow(
        lambda x: _verify(x, n, threshold), "fp binary, links bigint, texts bigint, least binary")
    found = checkpoint(found)
    links = found.groupBy("fp").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    same = components(found.select(F.col("fp").alias("a"), F.col("least").alias("b"))).withColumnRenamed("id", "fp")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp")
    names = same.join(classes.select("fp", "doc_id"), "fp").groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.min_by("fp", order).alias("keeper"))
    linked = links.join(same, "fp").join(names, "root").drop("root")
    return classes.drop("sig").join(linked, "fp", "left").select(
        "fp", "doc_id", "copies", "at_least", F.coalesce("keeper", "fp").alias("keeper"),
        F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).cast("bigint").alias("n_texts"))


def jaccard_join(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_texts."""
    classes = checkpoint(jaccard_classes(docs, **settings).select("fp", "class_id", "n_links", "n_texts"))
    return docs.select("doc_id", fingerprint().alias("fp")).join(classes, "fp").drop("fp")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id (of repeated rows any one)."""
    classes = jaccard_classes(docs, **settings).where("keeper = fp")
    classes = checkpoint(classes.select(F.col("fp").alias("_fp"), F.col("doc_id").alias("_id"), "at_least"))
    rows = docs.select(F.struct("*").alias("row"), fingerprint().alias("own"), F.col("doc_id").alias("own_id"))
    kept = rows.join(sized(classes, 48), (F.col("own") == F.col("_fp")) & F.col("own_id").eqNullSafe(F.col("_id")))
    once = kept.where("at_least = 1")
    again = kept.where("at_least > 1").dropDuplicates(["_fp"])
    return once.union(again).select("row.*")
