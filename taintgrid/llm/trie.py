"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

Each distinct sequence of first turns of the (rebuilt) conversations is a node. A node's name is a hash of its depth and of
the sum, modulo 2 ** 32 in four lanes, of hashes of each turn and its position; so the names of all prefixes are running
sums, taken over blocks of positions first, and neither a conversation nor the members of a node are ever held whole.

Subtree totals: rounds of two steps shrink the tree to its root. Rake adds every leaf's total to its parent and removes it,
all leaves of a parent at once by a partial aggregate. Compress removes unary nodes of which no two are neighbours: the
child takes the place of its parent and keeps what lay between as a weight on its edge. Which of them go is read off
the bits of the depth, so a chain loses every second node a round; nodes that fall out of that pattern, as others were raked
away, throw a coin by hash. So rounds grow with the logarithm of the nodes, be the tree deep or wide, and the tables shrink by
a constant share a round. Then the rounds are run backwards: a compressed node's total is its own, the
weight of the edge below it and the total of its child, which is known by then.

Turn order: turn (null first), ties by the MD5 of role and text, so tied turns that differ are ordered the same everywhere.
Defined cases: rows without conv_id are in no conversation and are left out; null role or text is empty; repeated rows are turns of their own;
texts only go into hashes and word counts, whole; an empty table has no nodes; other columns are ignored and may have any name.
The SHA-256 over the ids of those ending at a node is one sequence by its definition: ids are sorted and joined in blocks of
CHUNK everywhere, and only the finished blocks of a node pass through one task, one batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taintgrid.session import checkpoint, ranked

SHARED_BY, LONGEST = 20, 4  # conversations c - c % 20 lend up to crc32(c) % 4 first turns
BLOCK = 4096  # positions of a conversation that one window sums up
CHUNK = 4096  # ids joined in one value
WORD = r"[^\x20\x09-\x0D]+"
_LANES = ["x0", "x1", "x2", "x3"]
_LOW = 0xFFFFFFFF


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), h, words: the turns of each conversation in order; h: hash of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("h"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    return checkpoint(ranked(checkpoint(narrow), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("h")], "i").drop("turn"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of every conversation and (conv_id, n, p, h, words) of its turns after the exchange of first turns."""
    own = turns(conversations)
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("m"))
    base = F.col("conv_id") - F.col("conv_id") % SHARED_BY
    lent = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LONGEST).alias("lent")
    asked = sizes.select("conv_id", "m", base.alias("base"), lent)
    lenders = sizes.select(F.col("conv_id").alias("base"), F.col("m").alias("theirs"))
    k = F.least("lent", F.coalesce("theirs", F.lit(0)))
    convs = checkpoint(asked.join(lenders, "base", "left").select("conv_id", "base", "lent", k.alias("k"), (k + F.greatest(F.col("m") - F.col("lent"), F.lit(0))).alias("n")))
    first = own.where(F.col("i") < LONGEST).select(F.col("conv_id").alias("base"), F.col("i").alias("p"), "h", "words")
    taken = convs.where("k > 0").join(first, "base").where("p <= k").select("conv_id", "n", "p", "h", "words")
    kept = own.join(convs, "conv_id").where("i > lent").select("conv_id", "n", (F.col("i") - F.col("lent") + F.col("k")).alias("p"), "h", "words")
    return convs.select("conv_id", "n"), taken.unionByName(kept)


def _name(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth.cast("string"), *[x.bitwiseAND(F.lit(_LOW)).cast("string") for x in lanes])))


def _root() -> Column:
    return _name(F.lit(0), [F.lit(0).cast("bigint")] * len(_LANES))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, n, p, words, node, parent: the node of each prefix and that of the prefix before."""
    wide = [F.xxhash64("h", "p", F.lit(seed)) for seed in (1, 2)]
    lanes = [part for x in wide for part in (x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32))]
    own = rows.select("conv_id", "n", "p", "words", F.floor((F.col("p") - 1) / BLOCK).alias("block"), *[x.alias(c) for c, x in zip(_LANES, lanes, strict=True)])
    own = checkpoint(own)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in _LANES]).select(
        "conv_id", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).bitwiseAND(F.lit(_LOW)).alias(f"b_{c}") for c in _LANES])
    upto = Window.partitionBy("conv_id", "block").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    run = own.select("*", *[F.sum(c).over(upto).alias(f"s_{c}") for c in _LANES]).join(blocks, ["conv_id", "block"])
    ends = [F.col(f"b_{c}") + F.col(f"s_{c}") for c in _LANES]
    starts = [e - F.col(c) for e, c in zip(ends, _LANES, strict=True)]
    return run.select("conv_id", "n", "p", "words", _name(F.col("p"), ends).alias("node"), _name(F.col("p") - 1, starts).alias("parent"))


def nodes_of(convs: DataFrame, found: DataFrame) -> DataFrame:
    """node, parent, depth, words, n_convs, conv_id of every prefix, the root's included."""
    real = found.groupBy("node", "parent", F.col("p").alias("depth"), "words").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        _root().alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("words"), "n_convs", "conv_id")
    return real.unionByName(root)


def ends_sha256(convs: DataFrame, found: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes at which a conversation ends."""
    ends = found.where("p = n").select("node", "conv_id").union(convs.where("n = 0").select(_root(), "conv_id"))
    placed = ranked(ends, ["node"], ["conv_id"], "rn")
    chunks = placed.groupBy("node", F.floor((F.col("rn") - 1) / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = chunks.select("node", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
        open_node, state = None, None
        for batch in batches:
            names, digests = [], []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == open_node:
                    state.update(b",")
                else:
                    if state is not None:
                        names.append(open_node)
                        digests.append(state.hexdigest())
                    open_node, state = node, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_node], pa.binary()), pa.array([state.hexdigest()], pa.string())], schema=schema)

    return joined.repartition("node").sortWithinPartitions("node", "chunk").mapInArrow(hashed, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """node and the sums of the value columns over its subtree, itself included, for every row of nodes (node, parent, depth, kids,
    values); parent is null at roots, depth grows from parent to child, kids is the number of children."""
    acc, edge = values, [f"e_{v}" for v in values]
    state = checkpoint(nodes.select("node", "parent", "depth", "kids", *values, *[F.lit(0).cast("bigint").alias(e) for e in edge]))
    raked, squeezed = [], []
    for r in count():
        leaf = (F.col("kids") == 0) & F.col("parent").isNotNull()
        leaves = state.where(leaf)
        raked.append(leaves.select("node", *acc))
        told = leaves.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_c"), *[F.sum(F.col(a) + F.col(e)).alias(f"_{a}") for a, e in zip(acc, edge, strict=True)])
        state = checkpoint(state.where(~leaf).join(told, "node", "left").select(
            "node", "parent", "depth", (F.col("kids") - F.coalesce("_c", F.lit(0))).alias("kids"), *[(F.col(a) + F.coalesce(f"_{a}", F.lit(0))).alias(a) for a in acc], *edge))
        if state.where("parent is not null").isEmpty():
            break
        bit = 1 << min(r, 30)
        in_turn = F.col("depth").bitwiseAND(F.lit(2 * bit - 1)) == bit
        late = (F.col("depth").bitwiseAND(F.lit(bit - 1)) != 0) & (F.xxhash64("node", F.lit(r)).bitwiseAND(F.lit(1)) == 1)
        willing = (F.col("kids") == 1) & F.col("parent").isNotNull() & (in_turn | late)
        upper = state.where(willing).select(F.col("node").alias("over"), F.col("parent").alias("_to"), *[F.col(a).alias(f"o_{a}") for a in acc], *[F.col(e).alias(f"o_{e}") for e in edge])
        pairs = checkpoint(state.where(F.col("parent").isNotNull() & ~willing).select("node", F.col("parent").alias("over"), *edge).join(upper, "over"))
        squeezed.append(pairs.select(F.col("over").alias("node"), F.col("node").alias("child"), *[(F.col(f"o_{a}") + F.col(e)).alias(a) for a, e in zip(acc, edge, strict=True)]))
        more = [(F.col(f"o_{a}") + F.col(f"o_{e}")).alias(f"_{e}") for a, e in zip(acc, edge, strict=True)]
        news = pairs.select("node", "_to", F.lit(False).alias("_gone"), *more).unionByName(
            pairs.select(F.col("over").alias("node"), F.lit(None).cast("binary").alias("_to"), F.lit(True).alias("_gone"), *[F.lit(0).cast("bigint").alias(f"_{e}") for e in edge]))
        state = checkpoint(state.join(news, "node", "left").where("not coalesce(_gone, false)").select(
            "node", F.coalesce("_to", "parent").alias("parent"), "depth", "kids", *acc, *[(F.col(e) + F.coalesce(f"_{e}", F.lit(0))).alias(e) for e in edge]))
    known = raked.pop().unionByName(state.select("node", *acc))  # those removed last, and the roots
    parts = [known]
    while squeezed:
        below = reduce(DataFrame.unionByName, parts).select(F.col("node").alias("child"), *[F.col(a).alias(f"_{a}") for a in acc])
        put_back = squeezed.pop().join(below, "child").select("node", *[(F.col(a) + F.col(f"_{a}")).alias(a) for a in acc])
        parts.append(checkpoint(raked.pop().unionByName(put_back)))
    return reduce(DataFrame.unionByName, parts)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rows = rebuilt(conversations)
    found = checkpoint(prefixes(rows))
    nodes = checkpoint(nodes_of(convs, found))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = checkpoint(nodes.join(kids, "node", "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
    sums = subtree_sums(
        nodes.select("node", "parent", "depth", "kids", (F.col("kids") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")),
        ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node").join(ends_sha256(convs, found), "node", "left").join(above, "parent", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
