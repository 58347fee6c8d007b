"""Merkle manifest of a dataset by slot pivots.

A row's leaf is the SHA-256 of its fields; the leaves of a group (a language) in order of doc_id, and then the groups'
roots in order of the group, are the bottom of a tree in which every `fanout` consecutive nodes have one parent, the
SHA-256 of their digests one after another; a last run may be shorter, even of one node. The top of a group is its
subroot, that of all groups the root.

Slot pivot: a node's place gives its parent (place div fanout) and its slot (place mod fanout); one conditional aggregate a
slot spreads the children of a parent over columns. Joining these columns and hashing gives the parent; joining them
without the own one gives the siblings. STRIDE levels are taken at once: a block of fanout ** STRIDE slots is spread over as
many columns, and the levels between are expressions over them, so a tree of n leaves takes log n / (STRIDE * log fanout)
shuffles up, and as many joins down, in which each block hands its path to the root on to its slots.

Digests are hex text, as they are hashed. Rows that go through the tree have a place, a group and a digest, never a text. Places are exact
ranks from range partitions, so a group that holds most rows is dealt out like any other, and blocks are bounded.

Defined cases: nulls are encoded as `-`; null groups are one group, the first; equal doc_ids (and null ones, which come first)
are ordered by leaf; repeated rows are leaves of their own, at successive places; an empty table has no rows and no root;
other columns are ignored and may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.session import checkpoint, ranked

FANOUT = 2
STRIDE = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _joined(nodes: list[Column]) -> Column:
    """Present digests one after another; null if there are none."""
    text = F.concat(*[F.coalesce(n, F.lit("")) for n in nodes])
    return F.when(text != "", text)


def _levels(count: Column, fanout: int) -> Column:
    """Levels above n nodes until one is left, counted in whole numbers: each takes ceil(n / fanout)."""
    powers = [fanout**k for k in range(63) if fanout**k < 1 << 62]
    return reduce(lambda a, b: a + b, [(count > p).cast("int") for p in powers])


def tree(nodes: DataFrame, fanout: int = FANOUT, stride: int = STRIDE) -> DataFrame:
    """Columns g, place, digest in; g, place, digest, top, path out: the top of g's tree and, for each level from the node to
    the top, what stands left and right of its branch. g is not null; places of a g go from 0 without gaps."""
    width = fanout**stride
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).select("g", _levels(F.col("_n"), fanout).alias("left"))
    level = checkpoint(nodes.select("g", "place", "digest").join(sizes, "g"))
    blocks = []
    names = [f"s{i}" for i in range(width)]
    while True:
        slot = F.pmod("place", F.lit(width))
        block = level.groupBy("g", F.floor(F.col("place") / width).alias("block")).agg(
            F.first("left").alias("left"), *[F.max(F.when(slot == i, F.col("digest"))).alias(n) for i, n in enumerate(names)])
        # one level of expressions a projection, so that no digest is computed twice
        rows, have = block, list(names)
        for k in range(stride):
            runs = [have[i : i + fanout] for i in range(0, len(have), fanout)]
            have = [f"l{k + 1}_{i}" for i in range(len(runs))]
            rows = rows.select("*", *[
                F.when(F.col("left") > k, F.sha2(_joined([F.col(c) for c in run]), 256)).otherwise(F.col(run[0])).alias(name)
                for name, run in zip(have, runs, strict=True)])
        blocks.append(checkpoint(rows.withColumnRenamed(have[0], "top")))
        level = blocks[-1].select("g", F.col("block").alias("place"), F.greatest(F.col("left") - stride, F.lit(0)).alias("left"), F.col("top").alias("digest"))
        if blocks[-1].where("block > 0").isEmpty():
            break
    empty = F.expr("cast(array() as array<struct<before:string,after:string>>)")
    above = blocks[-1].select("g", "block", F.col("top").alias("root"), empty.alias("path"))
    for rows in reversed(blocks):
        columns = [names] + [[f"l{k}_{i}" for i in range(width // fanout**k)] for k in range(1, stride)]
        shared = rows.join(above, ["g", "block"])
        slots = [
            F.struct(
                F.lit(i).alias("slot"), F.col(n).alias("digest"),
                F.slice(F.array(*[_beside(columns[k], i // fanout**k, fanout) for k in range(stride)]), F.lit(1), F.least("left", F.lit(stride))).alias("own"))
            for i, n in enumerate(names)]
        above = (
            shared.select("g", "block", "root", "path", F.explode(F.array(*slots)).alias("x")).where("x.digest is not null")
            .select("g", (F.col("block") * width + F.col("x.slot")).alias("block"), F.col("x.digest").alias("digest"), "root", F.concat("x.own", "path").alias("path"))
        )
        if rows is not blocks[0]:
            above = checkpoint(above.drop("digest"))
    return above.select("g", F.col("block").alias("place"), "digest", F.col("root").alias("top"), "path")


def _beside(level: list[str], i: int, fanout: int) -> Column:
    """The other nodes of i's run: those before and those after it."""
    first = i - i % fanout
    text = lambda names: F.concat(F.lit(""), *[F.coalesce(F.col(n), F.lit("")) for n in names])
    return F.struct(text(level[first:i]).alias("before"), text(level[i + 1 : first + fanout]).alias("after"))


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and what stands beside its branch lead to."""
    return F.aggregate(path, leaf_digest, lambda cur, step: F.sha2(F.concat(step["before"], cur, step["after"]), 256))


def proof(path: Column) -> Column:
    """All siblings, level by level, from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(rows: DataFrame, id_col: str = "doc_id", fanout: int = FANOUT, stride: int = STRIDE) -> DataFrame:
    """The tree over rows: columns id_col, grp, leaf and any others. Gives these with subroot, root and path: the siblings'
    digests before and after the branch at each level, through the subroot up to the root."""
    g = F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit(""))  # null first, then bytewise
    kept = checkpoint(rows.withColumn("g", g))
    places = checkpoint(ranked(kept, ["g"], [F.col(id_col).asc_nulls_first(), F.col("leaf")], "place").withColumn("place", F.col("place") - 1))
    own = checkpoint(tree(places.select("g", "place", F.col("leaf").alias("digest")), fanout, stride))
    tops = own.where("place = 0").select("g", F.col("top").alias("digest"))
    order = ranked(tops, [], ["g"], "place").select(F.lit("").alias("g"), (F.col("place") - 1).alias("place"), "digest", F.col("g").alias("of"))
    order = checkpoint(order)
    whole = tree(order.drop("of"), fanout, stride).select("place", F.col("top").alias("root"), F.col("path").alias("rest"))
    groups = order.select("place", F.col("of").alias("g")).join(whole, "place").drop("place")
    found = own.select("g", "place", F.col("top").alias("subroot"), "path").join(groups, "g")
    return places.join(found, ["g", "place"]).withColumn("path", F.concat("path", "rest")).drop("g", "place", "rest")


def check_rows(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs; rows whose doc_id has a CRC-32
    that 7 divides are tampered with before they are folded: n_chars grows by one."""
    longer = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    values = [F.col(c) for c in FIELDS]
    rows = docs.select(
        "doc_id", F.col("lang").cast("string").alias("grp"), leaf(values).alias("leaf"),
        F.when(altered, leaf([longer if c == "n_chars" else F.col(c) for c in FIELDS])).alias("shown"))
    out = manifest(rows, fanout=fanout)
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("shown", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
