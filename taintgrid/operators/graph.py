"""Graph queries as fixed-point joins.

Edges are rows (keys, src, dst). `keys` name the graph a row belongs to: a project and method for
method graphs, or nothing for one global graph. Every loop joins a small frontier with the edges,
removes what it has seen, and cuts its lineage through the checkpoint folder. State is one row per
node (or per seed and node where the answer is about seeds), never pairs of a whole group.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.operators import masks
from taintgrid.operators.cycles import SMALL, closed, contracted_components, has, large_graphs, small_components, small_graphs
from taintgrid.operators.state import Levels, bucketed, stored
from taintgrid.session import checkpoint, top_n

ROW_MARKS = 128  # edges and marked nodes of a graph whose paths are found in one row


def _seen_union(parts: list[DataFrame]) -> list[DataFrame]:
    """Merge a long list of small frames into one written frame."""
    if len(parts) < 8:
        return parts
    return [checkpoint(_union(parts))]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def closure(
    edges: DataFrame, seeds: DataFrame, keys: list[str], max_depth: int | None = None,
    blocked: DataFrame | None = None,
) -> DataFrame:
    """Nodes reached from seeds, with the fewest hops.

    `seeds` has keys, `node`, and any further columns (for example `seed`) that are carried along:
    reach is then per distinct carried value. Result: seed columns + `depth`. `blocked(keys, node)`
    are neither entered nor passed; blocked seeds are kept but not expanded.
    """
    tags = [c for c in seeds.columns if c not in (*keys, "node")]
    ident = [*keys, *tags, "node"]
    edges = edges.select(*keys, "src", "dst").distinct()
    if blocked is not None:
        gone = blocked.select(*keys, "node").distinct()
        edges = edges.join(gone.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti").join(
            gone.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_anti"
        )
    edges = bucketed(edges, [*keys, "src"])
    level = stored(seeds.select(*ident).distinct().withColumn("depth", F.lit(0)), ident, dealt=True)
    seen = Levels(ident)
    seen.add(level)
    for depth in count(1):
        if not level.rows or (max_depth is not None and depth > max_depth):
            break
        step = (
            level.frame.select(*keys, *tags, F.col("node").alias("src"))
            .join(edges, [*keys, "src"])
            .select(*keys, *tags, F.col("dst").alias("node"))
            .distinct()
        )
        level = stored(seen.without(step).withColumn("depth", F.lit(depth)), ident, dealt=True)
        if level.rows:
            seen.add(level)
    return seen.all()


def reachable(edges: DataFrame, seeds: DataFrame, keys: list[str], max_depth: int | None = None) -> DataFrame:
    """Nodes reachable from seeds (seeds included), with depth."""
    return closure(edges, seeds, keys, max_depth)


def neighbors(edges: DataFrame, ids: DataFrame, keys: list[str], direction: str = "out") -> DataFrame:
    """Edges leaving (`out`) or entering (`in`) a node set."""
    end = "src" if direction == "out" else "dst"
    return edges.join(ids.select(*keys, F.col("node").alias(end)).distinct(), [*keys, end], "left_semi")


def induced_edges(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with both ends in the node set."""
    ids = nodes.select(*keys, "node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), [*keys, "src"], "left_semi").join(
        ids.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_semi"
    ).select(*edges.columns)


def select_nodes(
    nodes: DataFrame, kinds: list[str] | None = None, method_id: str | None = None, file: str | None = None,
    flags: list[str] | None = None,
) -> DataFrame:
    """Node subset by kind, method, file and boolean flag columns."""
    if kinds:
        nodes = nodes.where(F.col("kind").isin(*kinds))
    if method_id:
        nodes = nodes.where(F.col("method_id") == method_id)
    if file:
        nodes = nodes.where(F.col("file") == file)
    for f in flags or []:
        nodes = nodes.where(F.col(f))
    return nodes


# --- paths ------------------------------------------------------------------------------


def _toward(edges: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dst_node, node): nodes from which a wanted target can be reached."""
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = pairs.select(*keys, F.col("target").alias("goal"), F.col("target").alias("node")).distinct()
    return closure(back, ends, keys).select(*keys, "goal", "node")


def simple_paths(
    edges: DataFrame, pairs: DataFrame, keys: list[str], cutoff: int | None = None, max_paths: int | None = None,
) -> DataFrame:
    """Paths without repeated nodes for each pair (keys, source, target), with a `cutoff` of at most so many edges.

    Partial paths are kept only at nodes that still reach the target. With `max_paths`, the first
    ones by (length, path) are reported. Result: keys, source, target, hops, path.
    """
    edges = checkpoint(edges.select(*keys, "src", "dst").distinct())
    live = checkpoint(_toward(edges, pairs, keys).withColumnRenamed("goal", "target"))
    state = checkpoint(
        pairs.select(*keys, "source", "target").distinct()
        .withColumn("node", F.col("source"))
        .join(live, [*keys, "target", "node"], "left_semi")
        .withColumn("path", F.array("source"))
    )
    done = [state.where("node = target").withColumn("hops", F.lit(0))]
    for hop in count(1):
        if cutoff is not None and hop > cutoff:
            break
        step = (
            state.where("node <> target").select(*keys, "source", "target", F.col("node").alias("src"), "path")
            .join(edges, [*keys, "src"])
            .where(~F.array_contains("path", F.col("dst")))
            .select(*keys, "source", "target", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
            .join(live, [*keys, "target", "node"], "left_semi")
        )
        state = checkpoint(step)
        if state.isEmpty():
            break
        done.append(state.where("node = target").withColumn("hops", F.lit(hop)))
    out = _union(done).select(*keys, "source", "target", "hops", "path").where("hops > 0")
    if max_paths is not None:
        out = top_n(out, [*keys, "source", "target"], [F.col("hops"), F.col("path")], max_paths, "path_no")
    return out


def _first_paths(edges: DataFrame, seeds: DataFrame, keys: list[str], cutoff: int | None = None) -> DataFrame:
    """Seed columns + `path`: for every node reached, its shortest path from the seed; ties go to
    the smallest path. One row per (seed, node) is enough: on equal length the smallest path to a
    node extends the smallest path to its predecessor."""
    tags = [c for c in seeds.columns if c not in (*keys, "node")]
    ident = [*keys, *tags, "node"]
    frontier = checkpoint(seeds.select(*ident).distinct().withColumn("path", F.array("node")))
    seen = [frontier]
    for hop in count(1):
        if cutoff is not None and hop > cutoff:
            break
        step = (
            frontier.select(*keys, *tags, F.col("node").alias("src"), "path")
            .join(edges, [*keys, "src"])
            .groupBy(*keys, *tags, F.col("dst").alias("node"))
            .agg(F.min("path").alias("path"))
            .withColumn("path", F.array_append("path", F.col("node")))
        )
        step = step.join(_union(seen).select(*ident), ident, "left_anti")
        frontier = checkpoint(step)
        if frontier.isEmpty():
            break
        seen = _seen_union([*seen, frontier])
    return _union(seen)


def nearest_paths(edges: DataFrame, seeds: DataFrame, wanted: DataFrame, blocked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, path): the wanted nodes that seeds reach without entering or passing a blocked one, each with its shortest path
    from any seed over all edges, blocked nodes included; ties go to the smallest path. Blocked seeds are reached, but not passed.

    Graphs of few edges and marks are solved in one row each, only the others go through rounds. There must be a key.
    """
    edges = edges.select(*keys, "src", "dst")
    node = lambda df, mark: df.select(*keys, F.lit(mark).alias("_m"), "node", F.lit(None).cast(edges.schema["dst"].dataType).alias("_to"))
    rows = edges.select(*keys, F.lit("e").alias("_m"), F.col("src").alias("node"), F.col("dst").alias("_to")).union(
        node(seeds, "s")).union(node(wanted, "w")).union(node(blocked, "b"))
    large = checkpoint(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROW_MARKS).drop("_n"))
    if large.isEmpty():
        return _small_nearest(rows, keys)
    part = lambda df: df.join(large, keys, "left_semi")
    edges, seeds = checkpoint(part(edges).distinct()), part(seeds).select(*keys, "node")
    reached = closure(edges, seeds, keys, blocked=part(blocked)).select(*keys, "node").join(wanted, [*keys, "node"], "left_semi")
    return _small_nearest(rows.join(large, keys, "left_anti"), keys).unionByName(
        _first_paths(edges, seeds, keys).join(reached, [*keys, "node"], "left_semi").select(*keys, "node", "path"))


def _held(df: DataFrame, keys: list[str], *columns: Column | str) -> DataFrame:
    """keys and columns, which the next step reads and doesn't make anew for each node of a row."""
    return df.select(*keys, F.explode(F.array(F.struct(*columns))).alias("_x")).select(*keys, "_x.*")


def _small_nearest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`nearest_paths` of graphs whose edges (e), seeds (s), wanted (w) and blocked nodes (b) fit in one row. Nodes are places in their
    order, so a list of places compares as the list of their names; a round of each fold knows paths of one more edge."""
    marked = lambda mark, value: F.collect_set(F.when(F.col("_m") == mark, value))
    row = rows.groupBy(*keys).agg(
        marked("e", F.struct(F.col("node").alias("src"), F.col("_to").alias("dst"))).alias("_e"), marked("s", F.col("node")).alias("_s"),
        marked("w", F.col("node")).alias("_w"), marked("b", F.col("node")).alias("_b")).where("size(_s) > 0 and size(_w) > 0")
    ids = F.array_sort(F.array_distinct(F.concat(F.transform("_e", lambda e: e["src"]), F.transform("_e", lambda e: e["dst"]), F.col("_s"))))
    at = lambda name: F.array_position(F.col("ids"), name).cast("int") - 1
    row = _held(row, keys, ids.alias("ids"), "_e", "_s", "_w", "_b")
    shut = lambda name: F.array_contains("_b", name)
    row = _held(
        row, keys, "ids", F.filter(F.transform("_w", at), lambda w: w >= 0).alias("_w"), F.transform("_s", at).alias("_s"),
        F.transform("_e", lambda e: F.struct(at(e["src"]).alias("p"), at(e["dst"]).alias("v"), (shut(e["src"]) | shut(e["dst"])).alias("shut"))).alias("_e"))
    fed = lambda also: F.transform("ids", lambda _, v: F.transform(F.filter("_e", lambda e: (e["v"] == v) & also(e)), lambda e: e["p"]))
    row = _held(row, keys, "ids", "_w", "_s", fed(lambda e: F.lit(True)).alias("_fed"), fed(lambda e: ~e["shut"]).alias("_open"))
    seed = lambda v: F.array_contains("_s", v)
    met = F.aggregate(
        "ids", F.transform("ids", lambda _, v: seed(v)),
        lambda acc, _: F.transform(acc, lambda x, v: x | F.exists(F.get("_open", v), lambda p: F.get(acc, p))))
    path = F.aggregate(
        "ids", F.transform("ids", lambda _, v: F.when(seed(v), F.array(v))),
        lambda acc, _: F.transform(acc, lambda x, v: F.when(x.isNotNull(), x).otherwise(F.concat(
            F.array_min(F.transform(F.filter(F.get("_fed", v), lambda p: F.get(acc, p).isNotNull()), lambda p: F.get(acc, p))), F.array(v)))))
    row = _held(row, keys, "ids", "_w", "_fed", "_s", met.alias("_met")).where(F.exists("_w", lambda w: F.get("_met", w)))
    row = _held(row, keys, "ids", "_w", "_met", path.alias("_path"))
    out = row.select(*keys, "ids", "_path", F.explode(F.filter("_w", lambda w: F.get("_met", w))).alias("_v"))
    return out.select(*keys, F.get("ids", F.col("_v")).alias("node"), F.transform(F.get("_path", F.col("_v")), lambda i: F.get("ids", i)).alias("path"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, keys: list[str], cutoff: int | None = None) -> DataFrame:
    """The shortest path per pair (keys, source, target), smallest path on ties, with `hops`."""
    edges = checkpoint(edges.select(*keys, "src", "dst").distinct())
    seeds = pairs.select(*keys, "source", F.col("source").alias("node"))
    found = _first_paths(edges, seeds, keys, cutoff).withColumnRenamed("node", "target")
    return (
        pairs.select(*keys, "source", "target").distinct()
        .join(found, [*keys, "source", "target"])
        .withColumn("hops", F.size("path") - 1)
    )


# --- cycles -----------------------------------------------------------------------------


def _trim(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Drop edges that cannot lie on a cycle: no edge enters their start or leaves their end."""
    size = edges.count()
    while size:
        starts = edges.select(*keys, F.col("src").alias("dst")).distinct()
        ends = edges.select(*keys, F.col("dst").alias("src")).distinct()
        edges = checkpoint(edges.join(starts, [*keys, "dst"], "left_semi").join(ends, [*keys, "src"], "left_semi"))
        left = edges.count()
        if left == size:
            break
        size = left
    return edges


def _spread_max(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Per node the largest ancestor (f) and largest descendant (b), itself included."""
    nodes = edges.select(*keys, F.col("src").alias("node")).union(edges.select(*keys, F.col("dst").alias("node"))).distinct()
    labels = checkpoint(nodes.select(*keys, "node", F.col("node").alias("f"), F.col("node").alias("b"), F.lit(True).alias("new")))
    while True:
        moved = labels.where("new")
        ahead = moved.select(*keys, F.col("node").alias("src"), "f").join(edges, [*keys, "src"]).select(
            *keys, F.col("dst").alias("node"), "f", F.lit(None).cast(labels.schema["b"].dataType).alias("b")
        )
        behind = moved.select(*keys, F.col("node").alias("dst"), "b").join(edges, [*keys, "dst"]).select(
            *keys, F.col("src").alias("node"), F.lit(None).cast(labels.schema["f"].dataType).alias("f"), "b"
        )
        told = ahead.unionByName(behind).groupBy(*keys, "node").agg(F.max("f").alias("f2"), F.max("b").alias("b2"))
        up_f, up_b = F.coalesce(F.col("f2") > F.col("f"), F.lit(False)), F.coalesce(F.col("b2") > F.col("b"), F.lit(False))
        labels = checkpoint(
            labels.drop("new").join(told, [*keys, "node"], "left").select(
                *keys, "node",
                F.when(up_f, F.col("f2")).otherwise(F.col("f")).alias("f"),
                F.when(up_b, F.col("b2")).otherwise(F.col("b")).alias("b"),
                (up_f | up_b).alias("new"),
            )
        )
        if labels.where("new").isEmpty():
            break
    return labels.drop("new")


def _coloured(rest: DataFrame, keys: list[str]) -> DataFrame:
    """Components over edges without loops. Acyclic parts are trimmed. Then every node learns its largest ancestor and
    descendant; where the two are equal the node is in that node's component. Edges between nodes with different
    pairs cannot be inside a component and are cut; the rest repeats on what is left."""
    rest = _trim(rest, keys)
    found = [rest.select(*keys, F.col("src").alias("node"), F.col("src").alias("component")).limit(0)]
    while not rest.isEmpty():
        labels = checkpoint(_spread_max(rest, keys))
        found.append(labels.where("f = b").select(*keys, "node", F.col("f").alias("component")))
        open_ = labels.where("f <> b")
        src = open_.select(*keys, F.col("node").alias("src"), F.struct("f", "b").alias("ls"))
        dst = open_.select(*keys, F.col("node").alias("dst"), F.struct("f", "b").alias("ld"))
        kept = rest.join(src, [*keys, "src"]).join(dst, [*keys, "dst"]).where("ls = ld").select(*keys, "src", "dst")
        rest = _trim(checkpoint(kept), keys)
    return _union(found)


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Strongly connected components with a cycle: (keys, node, component), component being its largest node."""
    edges = checkpoint(edges.select(*keys, "src", "dst").distinct())
    loops = edges.where("src = dst").select(*keys, F.col("src").alias("node"), F.col("src").alias("component"))
    # a node alone in its component is on a cycle only by a self-loop
    inside = checkpoint(_cyclic(edges.where("src <> dst"), keys))
    return inside.unionByName(loops.join(inside, [*keys, "node"], "left_anti"))


def _cyclic(edges: DataFrame, keys: list[str]) -> DataFrame:
    """`components` of two nodes or more: graphs of few edges are solved in one row each, only the others go through rounds."""
    rounds = lambda some: contracted_components(some, keys, lambda rest: _coloured(rest, keys))
    if not keys:
        return rounds(edges)
    large = large_graphs(edges, keys)
    few = small_components(edges if large.isEmpty() else edges.join(large, keys, "left_anti"), keys)
    few = few.withColumnRenamed("rep", "component")
    return few if large.isEmpty() else few.unionByName(rounds(edges.join(large, keys, "left_semi")))


def cycle_nodes(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes that lie on any cycle."""
    return components(edges, keys).select(*keys, "node").distinct()


# --- control-flow questions ---------------------------------------------------------------


def dominators(edges: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entry columns + `doms`: nodes on every path from the entry to node, itself included.

    `entries` has keys, `node` and any further columns that tell several entries of one graph
    apart. Only nodes reached from the entry have a row. Graphs of at most SMALL nodes are solved in one row.
    For others the first guess is one path to the node; sets then shrink to what every predecessor
    set holds, and only successors of changed nodes are looked at again.
    """
    tags = [c for c in entries.columns if c not in (*keys, "node")]
    ident = [*keys, *tags, "node"]
    edges = checkpoint(edges.select(*keys, "src", "dst").distinct())
    if not keys:
        return _spread_dominators(edges, entries, keys)
    entries = entries.select(*ident).distinct()
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()
    large = checkpoint(ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL).drop("_n"))
    if large.isEmpty():
        return _small_dominators(edges, entries, keys)
    few = _small_dominators(edges.join(large, keys, "left_anti"), entries.join(large, keys, "left_anti"), keys)
    return few.unionByName(_spread_dominators(checkpoint(edges.join(large, keys, "left_semi")), entries.join(large, keys, "left_semi"), keys))


def _small_dominators(edges: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """`dominators` of graphs of at most SMALL nodes: the set of each node is a long, all bits at first, and becomes the node and what the
    sets of all its predecessors share. A round knows paths of one more edge, so as many rounds as nodes are enough."""
    tags = [c for c in entries.columns if c not in (*keys, "node")]
    # written, so that the steps below read the sets and don't make them anew
    rows = entries.join(checkpoint(small_graphs(edges, keys)), keys)
    at = F.array_position("ids", F.col("node")).cast("int") - 1
    places = F.sequence(F.lit(0), F.size("ids") - 1)
    every, one = F.lit(-1).cast("bigint"), F.lit(1).cast("bigint")
    bit = lambda i: F.call_function("shiftleft", one, i.cast("int"))
    fed = F.transform(places, lambda v: F.filter(places, lambda p: has(F.get("next", p), v)))  # places of the predecessors
    rows = rows.where("array_contains(ids, node)").withColumn("_at", at).withColumn("_fed", fed)
    first = F.transform(places, lambda v: F.when(v == F.col("_at"), bit(v)).otherwise(every))
    shared = lambda sets, v: F.aggregate(F.get("_fed", v), every, lambda acc, p: acc.bitwiseAND(F.get(sets, p)))
    step = lambda sets, _: F.transform(sets, lambda x, v: F.when(v == F.col("_at"), x).otherwise(bit(v).bitwiseOR(shared(sets, v))))
    solved = checkpoint(rows).withColumn("_sets", F.aggregate(places, first, step))
    out = solved.select(*keys, *tags, "ids", F.posexplode("_sets").alias("_v", "_set")).where("_set <> -1").select(
        *keys, *tags, F.get("ids", F.col("_v")).alias("node"),
        F.filter("ids", lambda x, i: has(F.col("_set"), i)).alias("doms"))
    nodes = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"))
    alone = entries.join(nodes, [*keys, "node"], "left_anti").select(*keys, *tags, "node", F.array("node").alias("doms"))
    return out.unionByName(alone)


def _spread_dominators(edges: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """`dominators` of graphs of any size, by rounds."""
    tags = [c for c in entries.columns if c not in (*keys, "node")]
    ident = [*keys, *tags, "node"]
    doms = _first_paths(edges, entries, keys).select(*ident, F.col("path").alias("doms"), F.lit(True).alias("new"))
    doms = checkpoint(doms)
    while True:
        told = checkpoint(
            doms.where("new").select(*keys, *tags, F.col("node").alias("src"), F.col("doms").alias("held"))
            .join(edges, [*keys, "src"])
            .select(*keys, *tags, F.col("dst").alias("node"), "held")
        )
        teachers = told.groupBy(*ident).agg(F.count(F.lit(1)).alias("_n"))
        shared = (
            told.withColumn("d", F.explode("held")).groupBy(*ident, "d").agg(F.count(F.lit(1)).alias("_c"))
            .join(teachers, ident).where("_c = _n")
            .groupBy(*ident).agg(F.collect_set("d").alias("common"))
        )
        own = F.filter("doms", lambda d: (d == F.col("node")) | F.array_contains("common", d))
        kept = F.when((F.size("doms") > 1) & F.col("common").isNotNull(), own).otherwise(F.col("doms"))
        doms = checkpoint(
            doms.drop("new").join(shared, ident, "left").withColumn("kept", kept)
            .select(*ident, F.col("kept").alias("doms"), (F.size("kept") < F.size("doms")).alias("new"))
        )
        if doms.where("new").isEmpty():
            break
    return doms.select(*ident, F.array_sort("doms").alias("doms"))


def on_all_paths(edges: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, target, node): nodes other than the ends on every path source -> target.

    These are the dominators of the target in the graph entered at the source.
    """
    tagged = pairs.select(*keys, "source", "target").distinct()
    doms = dominators(edges, tagged.select(*keys, "source", F.col("source").alias("node")).distinct(), keys)
    out = tagged.join(doms.withColumnRenamed("node", "target"), [*keys, "source", "target"])
    return out.withColumn("node", F.explode("doms")).where("node <> source and node <> target").drop("doms")


def all_paths_hit(edges: DataFrame, pairs: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs plus `is_hit`: every path source -> target meets a marked node (ends count).

    False without a path. Graphs of few edges are solved in one row. In others two masks spread from all sources at once: by `mask` a source reaches a node, by `clean` it does so
    without a marked node so far. The pair is hit when the target is reached, but never clean.
    """
    marks = marked.select(*keys, "node").distinct().withColumn("_m", F.lit(True))
    # each edge knows whether its end is marked, so a round is one join with the edges
    edges = edges.select(*keys, "src", "dst").distinct().join(marks.withColumnRenamed("node", "dst"), [*keys, "dst"], "left").select(
        *keys, "src", "dst", F.col("_m").isNull().alias("open"))
    asked = pairs.select(*keys, "source", "target").distinct()
    if keys:
        edges = checkpoint(edges)
        large = large_graphs(edges, keys)
        if large.isEmpty():
            hit = _small_hits(edges, asked, marks, keys)
        else:
            part = lambda df, how: df.join(large, keys, how)
            hit = _small_hits(part(edges, "left_anti"), part(asked, "left_anti"), marks, keys).unionByName(
                _spread_hits(part(edges, "left_semi"), part(asked, "left_semi"), marks, keys))
    else:
        hit = _spread_hits(edges, asked, marks, keys)
    return pairs.join(hit.withColumn("_hit", F.lit(True)), [*keys, "source", "target"], "left").withColumn("is_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _small_hits(edges: DataFrame, asked: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """The hit pairs of `all_paths_hit` in graphs of at most SMALL nodes, each solved in one row: the sets that all edges, and those to
    unmarked nodes only, lead to. A pair whose ends are one node needs no edge."""
    rows = small_graphs(edges.join(asked.select(*keys).distinct(), keys, "left_semi"), keys, "open")
    rows = rows.select(*keys, "ids", closed(F.col("ids"), F.col("next")).alias("_all"), closed(F.col("ids"), F.col("gated")).alias("_free"))
    both = asked.join(rows, keys, "left").join(marks.withColumnRenamed("node", "source"), [*keys, "source"], "left")
    i, j = (F.array_position(F.col("ids"), F.col(end)) - 1 for end in ("source", "target"))
    at = lambda sets: (F.col("source") == F.col("target")) | F.coalesce((i >= 0) & (j >= 0) & has(F.get(sets, i), j), F.lit(False))
    return both.where(at("_all") & ~(F.col("_m").isNull() & at("_free"))).select(*keys, "source", "target")


def _spread_hits(edges: DataFrame, asked: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """The hit pairs of `all_paths_hit` by masks that spread in rounds."""
    numbers = checkpoint(masks.numbered(asked, keys, "source"))
    starts = numbers.withColumn("node", F.col("source")).join(marks, [*keys, "node"], "left")
    starts = starts.select(*keys, "grp", "node", masks.one_bit().alias("mask"), F.when(F.col("_m").isNull(), masks.one_bit()).otherwise(F.lit(0).cast("bigint")).alias("clean"))
    met = masks.spread(edges, starts, keys, {"mask": None, "clean": F.col("open")}).withColumnRenamed("node", "target")
    return asked.join(numbers, [*keys, "source"]).join(met, [*keys, "grp", "target"]).where(masks.holds("mask") & ~masks.holds("clean")).select(*keys, "source", "target")


def on_any_path(edges: DataFrame, pairs: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, target, node): marked nodes, other than the ends, on some walk source -> target."""
    asked = pairs.select(*keys, "source", "target").distinct()
    from_, ahead = masks.reach(edges, asked, keys, "source")
    to, behind = masks.reach(edges, asked, keys, "target", back=True)
    marks = marked.select(*keys, "node").distinct()
    # only marked nodes are written out seed by seed
    sources = masks.met(ahead.join(marks, [*keys, "node"], "left_semi"), from_, keys)
    targets = masks.met(behind.join(marks, [*keys, "node"], "left_semi"), to, keys)
    return (
        sources.join(asked, [*keys, "source"]).join(targets, [*keys, "node", "target"], "left_semi")
        .where("node <> source and node <> target").select(*keys, "source", "target", "node"))


def on_pair_walks(edges: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node): nodes on some walk from a source to a target of one of the pairs, its ends included. No pair is written out a node:
    a source's targets are masks as well, and a node is on a walk if it reaches one of the targets of a source that reaches it."""
    asked = pairs.select(*keys, "source", "target").distinct()
    from_, ahead = masks.reach(edges, asked, keys, "source")
    to, behind = masks.reach(edges, asked, keys, "target", back=True)
    wanted = asked.join(to, [*keys, "target"]).groupBy(*keys, "source", "grp").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("_wanted"))
    # sources with the same targets count once, as one mask of sources
    alike = wanted.join(from_.select(*keys, "source", F.col("grp").alias("_g"), "bit"), [*keys, "source"]).groupBy(*keys, "_g", "grp", "_wanted").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("_sources"))
    seen = ahead.select(*keys, "node", F.col("grp").alias("_g"), "mask").join(alike, [*keys, "_g"]).where(F.col("mask").bitwiseAND(F.col("_sources")) != 0)
    open_ = seen.groupBy(*keys, "node", "grp").agg(F.expr("bit_or(_wanted)").alias("_wanted"))
    return open_.join(behind, [*keys, "node", "grp"]).where(F.col("mask").bitwiseAND(F.col("_wanted")) != 0).select(*keys, "node").distinct()


def topo_levels(nodes: DataFrame, edges: DataFrame, keys: list[str], entries: DataFrame | None = None) -> DataFrame:
    """(keys, node, level, is_cyclic). Acyclic graphs: longest path from a start. Graphs with a
    cycle: hops from the entry, where one is given. Graphs of few nodes and edges are solved in one row each."""
    if not keys:
        return _spread_levels(nodes, edges, keys, entries)
    edges = edges.select(*keys, "src", "dst")
    node = lambda df, mark: df.select(*keys, F.lit(mark).alias("_m"), "node", F.lit(None).cast(edges.schema["dst"].dataType).alias("_to"))
    rows = edges.select(*keys, F.lit("e").alias("_m"), F.col("src").alias("node"), F.col("dst").alias("_to")).union(node(nodes, "n"))
    if entries is not None:
        rows = rows.union(node(entries, "s"))
    rows = checkpoint(rows)
    large = checkpoint(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROW_MARKS).drop("_n"))
    if large.isEmpty():
        return _small_levels(rows, keys)
    part = lambda df: df.join(large, keys, "left_semi")
    rest = _spread_levels(part(nodes), part(edges), keys, None if entries is None else part(entries))
    return _small_levels(rows.join(large, keys, "left_anti"), keys).unionByName(rest)


def _small_levels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`topo_levels` of graphs whose edges (e), nodes (n) and entries (s) fit in one row. In a round of the first fold a node is placed
    whose predecessors all are; a round of the second one goes one edge further from the entries."""
    marked = lambda mark, value: F.collect_set(F.when(F.col("_m") == mark, value))
    row = rows.groupBy(*keys).agg(
        marked("e", F.struct(F.col("node").alias("src"), F.col("_to").alias("dst"))).alias("_e"), marked("n", F.col("node")).alias("_own"),
        marked("s", F.col("node")).alias("_s"))
    ids = F.array_distinct(F.concat(F.transform("_e", lambda e: e["src"]), F.transform("_e", lambda e: e["dst"]), F.col("_own"), F.col("_s")))
    row = _held(row, keys, ids.alias("ids"), "_e", "_own", "_s")
    at = lambda name: F.array_position(F.col("ids"), name).cast("int") - 1
    fed = F.transform("ids", lambda x: F.transform(F.filter("_e", lambda e: e["dst"] == x), lambda e: at(e["src"])))
    row = _held(
        row, keys, "ids", fed.alias("_fed"), F.transform("ids", lambda x: F.array_contains("_own", x)).alias("_own"),
        F.transform("ids", lambda x: F.array_contains("_s", x)).alias("_s"))
    before = lambda acc, v: F.transform(F.get("_fed", v), lambda p: F.get(acc, p))
    ready = lambda acc, v: F.get("_own", v) & ~F.exists(F.get("_fed", v), lambda p: F.get(acc, p).isNull())
    none = F.transform("ids", lambda _: F.lit(None).cast("int"))
    placed = F.aggregate(
        "ids", none, lambda acc, _: F.transform(acc, lambda x, v: F.when(x.isNotNull(), x).otherwise(
            F.when(ready(acc, v), F.coalesce(F.array_max(before(acc, v)) + 1, F.lit(0))))))
    row = _held(row, keys, "ids", "_fed", "_own", "_s", placed.alias("_level"))
    cyclic = F.exists(F.sequence(F.lit(0), F.size("ids") - 1), lambda v: F.get("_own", v) & F.get("_level", v).isNull())
    row = _held(row, keys, "ids", "_fed", "_s", "_level", cyclic.alias("is_cyclic"))
    hops = F.aggregate(
        "ids", F.transform("_s", lambda s: F.when(s, 0)), lambda acc, _: F.transform(acc, lambda x, v: F.coalesce(x, F.array_min(before(acc, v)) + 1)))
    row = _held(row, keys, "ids", "is_cyclic", F.when(F.col("is_cyclic"), hops).otherwise(F.col("_level")).alias("_level"))
    out = row.select(*keys, F.explode(F.arrays_zip("ids", "_level")).alias("_x"), "is_cyclic")
    return out.select(*keys, F.col("_x.ids").alias("node"), F.col("_x._level").alias("level"), "is_cyclic").where("level is not null")


def _spread_levels(nodes: DataFrame, edges: DataFrame, keys: list[str], entries: DataFrame | None = None) -> DataFrame:
    """`topo_levels` of graphs of any size, by rounds."""
    edges = checkpoint(edges.select(*keys, "src", "dst").distinct())
    # peel nodes whose predecessors are all placed; what never peels belongs to a cyclic graph
    fed = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("open"))
    state = nodes.select(*keys, "node").distinct().join(fed, [*keys, "node"], "left").select(
        *keys, "node", F.coalesce("open", F.lit(0)).alias("open"), F.when(F.col("open").isNull(), 0).alias("level"))
    state = checkpoint(state)
    for level in count(1):
        placed = state.where(F.col("level") == level - 1).select(*keys, F.col("node").alias("src"))
        done = placed.join(edges, [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_d"))
        left = F.col("open") - F.coalesce("_d", F.lit(0))
        ready = F.col("level").isNull() & (left == 0)
        state = checkpoint(state.join(done, [*keys, "node"], "left").select(
            *keys, "node", left.alias("open"), F.when(ready, level).otherwise(F.col("level")).alias("level")))
        if state.where(F.col("level") == level).isEmpty():
            break
    stuck = state.where("level is null")
    if not keys:
        ordered = state if stuck.isEmpty() else state.limit(0)
        starts = None if entries is None or stuck.isEmpty() else entries
    else:
        cyclic = checkpoint(stuck.select(*keys).distinct())
        ordered = state.join(cyclic, keys, "left_anti")
        starts = None if entries is None else entries.join(cyclic, keys, "left_semi")
    out = ordered.select(*keys, "node", "level").withColumn("is_cyclic", F.lit(False))
    if starts is not None:
        hops = closure(edges, starts.select(*keys, "node"), keys).withColumnRenamed("depth", "level")
        out = out.unionByName(hops.select(*keys, "node", "level").withColumn("is_cyclic", F.lit(True)))
    return out


# --- subgraphs and counts -----------------------------------------------------------------


def taint_subgraph(nodes: DataFrame, edges: DataFrame, keys: list[str], pairs: DataFrame | None = None):
    """(nodes, edges). With pairs (source, target): the nodes on paths between them. Without: all
    tainted nodes and their direct successors."""
    if pairs is not None:
        ids = on_pair_walks(edges, pairs, keys)
    else:
        hot = nodes.where("is_tainted").select(*keys, "node")
        ids = hot.union(neighbors(edges, hot, keys).select(*keys, F.col("dst").alias("node"))).distinct()
    return nodes.join(ids, [*keys, "node"], "left_semi"), induced_edges(edges, ids, keys)


def method_subgraph(nodes: DataFrame, edges: DataFrame, keys: list[str], method_id):
    part = nodes.where(F.col("method_id") == method_id)
    return part, induced_edges(edges, part, keys)


def graph_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes that changed: newly_tainted, sanitized (in the later graph), still_tainted."""
    b = before.select(*keys, "node", F.col("is_tainted").alias("_was"))
    a = after.select(*keys, "node", F.col("is_tainted").alias("_is"), "is_sanitized")
    was, now = F.coalesce("_was", F.lit(False)), F.coalesce("_is", F.lit(False))
    return (
        b.join(a, [*keys, "node"], "full_outer")
        .withColumn(
            "changes",
            F.array_compact(F.array(
                F.when(now & ~was, "newly_tainted"),
                F.when(F.coalesce("is_sanitized", F.lit(False)), "sanitized"),
                F.when(now & was, "still_tainted"),
            )),
        )
        .select(*keys, "node", F.explode("changes").alias("change"))
    )


def graph_stats(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """One row per graph and metric: total_nodes, total_edges, node:<kind>, edge:<kind>, flags."""
    def metric(df: DataFrame, name: Column) -> DataFrame:
        return df.groupBy(*keys, name.alias("metric")).agg(F.count(F.lit(1)).alias("n"))

    parts = [
        metric(nodes, F.lit("total_nodes")), metric(edges, F.lit("total_edges")),
        metric(nodes, F.concat(F.lit("node:"), "kind")), metric(edges, F.concat(F.lit("edge:"), "edge_kind")),
    ]
    for flag in ("is_source", "is_sink", "is_sanitizer", "is_tainted"):
        if flag in nodes.columns:
            parts.append(metric(nodes.where(flag), F.lit(flag)))
    return _union(parts)


def priority_sample(nodes: DataFrame, keys: list[str], n: int = 200) -> DataFrame:
    """The n most telling nodes per graph: tainted sinks, tainted, sources, other sinks, the rest."""
    rank = (
        F.when(F.col("is_sink") & F.col("is_tainted"), 0).when(F.col("is_tainted"), 1)
        .when(F.col("is_source"), 2).when(F.col("is_sink"), 3).otherwise(4)
    )
    return top_n(nodes.withColumn("priority", rank), keys, [F.col("priority"), F.col("node")], n, "position")
