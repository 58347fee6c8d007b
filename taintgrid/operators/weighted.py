"""Confidence-weighted taint propagation over the unified graph.

Nodes: keys, node, kind, resolved_symbol, is_source, is_sink, is_sanitizer, is_async, is_in_loop,
and labels. Edges: keys, src, dst, edge_kind, is_conditional, via_alias.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.operators.graph import _union, neighbors
from taintgrid.operators.prefix import prefix_first
from taintgrid.operators.state import bucketed, counted
from taintgrid.session import checkpoint, top_n

# --- fixed values -------------------------------------------------------------------------
FACTORS = {
    "conditional": 0.80, "aliases": 0.92, "returned_by": 0.85, "captured_by": 0.88, "in_loop": 0.90, "indirect": 0.85,
    "await": 0.95, "lambda": 0.88, "after_partial": 0.75, "deep": 0.95, "via_alias": 0.92,
}
DEEP_AFTER = 5
MIN_CONFIDENCE = 0.30
FULL_STOP = 0.90
DEFINITE = 0.85
# Labels stronger than these are answered by any sanitizer.
LABEL_KINDS = {
    "EXTERNAL_INPUT": ["SQL_INJECTION", "XSS", "SSRF", "PATH_TRAVERSAL"],
    "STORED_INPUT": ["SQL_INJECTION", "XSS", "LOG_INJECTION"],
    "ENVIRONMENT_INPUT": ["COMMAND_INJECTION", "PATH_TRAVERSAL"],
}
ANY_SANITIZER_LABELS = ["USER_INPUT", "NETWORK_INPUT"]
TAG_ADVICE = {
    "sql_via_string_interpolation": "The value is put into the query text; pass it as a parameter instead.",
    "async_taint_flow": "The value crosses an await; validate it before the asynchronous call.",
    "linq_taint_flow": "The value passes through a query expression; validate it before the query runs.",
    "lambda_capture_taint": "The value is captured by a lambda; validate it before it is captured.",
    "collection_taint_flow": "The value is stored in a collection; validate items when they are added.",
    "partial_sanitizer_bypass": "A sanitizer covers only part of the flow; use one made for this sink.",
    "sink_in_loop": "The sink runs in a loop; move validation before the loop.",
    "inter_procedural_taint": "The value returns from another method; validate it where it enters.",
}
# ------------------------------------------------------------------------------------------


def graph_sources(nodes: DataFrame, edges: DataFrame, keys: list[str], entry_methods: DataFrame | None = None) -> DataFrame:
    """(keys, node): known sources; parameters of entry methods or of methods with a source; string
    builds with a source or tainted node right before them."""
    known = nodes.where("is_source").select(*keys, "node")
    params = nodes.where("kind = 'PARAMETER'")
    with_source = nodes.where("is_source and method_id is not null").select(*keys, "method_id").distinct()
    if entry_methods is not None:
        with_source = with_source.union(entry_methods.select(*keys, "method_id")).distinct()
    by_method = params.join(with_source, list(dict.fromkeys([*keys, "method_id"])), "left_semi").select(*keys, "node")
    hot = nodes.where("is_source" + (" or is_tainted" if "is_tainted" in nodes.columns else ""))
    fed = neighbors(edges, hot.select(*keys, "node"), keys).select(*keys, F.col("dst").alias("node")).distinct()
    builds = nodes.where("kind in ('STRING_INTERPOLATION', 'STRING_CONCAT')").join(fed, [*keys, "node"], "left_semi").select(*keys, "node")
    return known.union(by_method).union(builds).distinct()


def sanitizer_effect(nodes: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, san_confidence, san_kinds) of sanitizer nodes: exact symbol, else first prefix for
    the confidence; exact symbol only for the kinds."""
    san = rules.where("rule_type = 'sanitizer' and length(symbol) > 0")
    table = san.groupBy("symbol").agg(
        F.max_by("confidence_score", "ordinal").alias("san_confidence"), F.max_by("sanitizes", "ordinal").alias("san_kinds"),
        F.min("ordinal").alias("ordinal"))
    mine = nodes.where("is_sanitizer and resolved_symbol is not null").select(*keys, "node", "resolved_symbol")
    exact = table.select(F.col("symbol").alias("resolved_symbol"), F.col("san_confidence").alias("_exact"), "san_kinds")
    first = prefix_first(mine, table.select("symbol", "ordinal", F.col("san_confidence").alias("_first")), ["_first"])
    return first.join(exact, "resolved_symbol", "left").select(
        *keys, "node", F.coalesce("_exact", "_first", F.lit(0.0)).alias("san_confidence"), "san_kinds")


def sanitizer_decision(label: Column, confidence: Column, kinds: Column, threshold: float = FULL_STOP) -> Column:
    """'full', 'partial' or NULL for a taint label meeting a sanitizer."""
    relevant = label.isin(*ANY_SANITIZER_LABELS)
    for name, values in LABEL_KINDS.items():
        relevant = relevant | ((label == name) & C.has_any(kinds, values))
    open_list = kinds.isNull() | (F.size(kinds) <= 0)
    applies = (F.coalesce(confidence, F.lit(0.0)) > 0) & (open_list | relevant)
    return F.when(applies, F.when(confidence >= threshold, "full").otherwise("partial"))


def step_factor(depth: Column, after_partial: Column) -> Column:
    """Product of the confidence factors of one hop. `depth` counts the hops made before it."""
    def only(cond: Column, name: str) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), FACTORS[name]).otherwise(1.0)

    kind, edge = F.col("kind"), F.col("edge_kind")
    return (
        only(F.col("is_conditional"), "conditional") * only(edge == "aliases", "aliases") * only(edge == "returned_by", "returned_by")
        * only(edge == "captured_by", "captured_by") * only(F.col("is_in_loop"), "in_loop")
        * only(kind.isin("COLLECTION_ITEM", "LINQ_EXPRESSION"), "indirect") * only(kind == "AWAIT_EXPR", "await")
        * only(kind == "LAMBDA_CAPTURE", "lambda") * only(after_partial, "after_partial")
        * F.when(depth > DEEP_AFTER, F.pow(F.lit(FACTORS["deep"]), depth - DEEP_AFTER)).otherwise(1.0)
        * only(F.col("via_alias").isNotNull(), "via_alias")
    )


def propagate_counted(
    nodes: DataFrame, edges: DataFrame, sources: DataFrame, keys: list[str], effect: DataFrame | None = None,
    mode: str = "best", max_depth: int | None = None, min_confidence: float = MIN_CONFIDENCE, max_results: int | None = None,
    keep_path: bool = True, sticky_partial: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Results (keys, source, sink, taint_label, confidence, depth, flags, path) and, per level and source, how many steps had
    which fate (keys, source, depth, fate, n): go, sink, cycle (the node is on the walk already), weak (below
    min_confidence), blocked (by a full sanitizer), deep (cut by max_depth).

    `sources` has keys, node, taint_label. Walks stop at sinks and end below min_confidence; without max_depth nothing else
    ends them, and since steps lose confidence the more the deeper they are, every walk ends within a dozen or two.

    mode `best` keeps the best walk per (source, node) and level. It is exact for the best
    confidence per (source, sink): every factor is at most 1 and grows weaker with depth, so the
    best walk never repeats a node. A level is one join of the frontier with the bucketed hops and one aggregate;
    earlier levels aren't read again.
    mode `all` lists every simple path; only for small graphs. With max_results, the first results
    per source in (depth, path) order are kept, as a report limit.
    """
    flow = edges.where(C.is_data_flow())
    info = nodes.select(*keys, F.col("node").alias("dst"), "kind", "is_sink", "is_async", "is_in_loop")
    eff = effect if effect is not None else nodes.select(*keys, "node", F.lit(0.0).alias("san_confidence"), F.expr("cast(null as array<string>)").alias("san_kinds")).limit(0)
    via = F.col("via_alias") if "via_alias" in edges.columns else F.lit(None).cast("string").alias("via_alias")
    hops = bucketed(
        flow.select(*keys, "src", "dst", "edge_kind", "is_conditional", via).distinct().join(info, [*keys, "dst"])
        .join(eff.withColumnRenamed("node", "dst"), [*keys, "dst"], "left"), [*keys, "src"])
    start = sources.select(
        *keys, F.col("node").alias("source"), "node", "taint_label", F.lit(1.0).alias("confidence"), F.lit(False).alias("has_conditional"),
        F.lit(False).alias("has_async"), F.lit(False).alias("partial"), F.array("node").alias("path"),
        F.expr("cast(array() as array<struct<edge_kind:string,kind:string,is_conditional:boolean>>)").alias("steps"))
    frontier = checkpoint(start)
    ident = [*keys, "source", "node"] + (["partial"] if sticky_partial else [])
    levels, results = [], []
    for depth in count():
        raw = frontier.withColumnRenamed("node", "src").join(hops, [*keys, "src"])
        cycle = F.col("dst") == F.col("source")
        if keep_path or mode == "all":
            cycle = cycle | F.array_contains("path", F.col("dst"))
        stop = sanitizer_decision(F.col("taint_label"), F.col("san_confidence"), F.col("san_kinds"))
        # ties of the fourth place go up, whatever their last binary digit
        conf = F.round(F.col("confidence") * step_factor(F.lit(depth), F.col("partial")) + 1e-9, 4)
        now_partial = F.coalesce(stop == "partial", F.lit(False))
        deep = F.lit(max_depth is not None and depth >= max_depth)
        fate = (
            F.when(deep, "deep").when(cycle, "cycle").when(F.col("_conf") < min_confidence, "weak")
            .when(F.coalesce(stop == "full", F.lit(False)), "blocked").when(F.col("is_sink"), "sink").otherwise("go"))
        step = raw.withColumn("_conf", conf).select(
            *keys, "source", F.col("dst").alias("node"), fate.alias("fate"), "taint_label", F.col("_conf").alias("confidence"), "is_sink",
            F.col("has_conditional").alias("state_conditional"), F.col("has_async").alias("state_async"), F.col("partial").alias("state_partial"),
            (F.col("has_conditional") | F.col("is_conditional")).alias("has_conditional"),
            (F.col("has_async") | F.col("is_async") | (F.col("kind") == "AWAIT_EXPR")).alias("has_async"),
            ((F.col("partial") | now_partial) if sticky_partial else now_partial).alias("partial"),
            (F.array_append("path", F.col("dst")) if keep_path else F.col("path")).alias("path"),
            (F.array_append("steps", F.struct("edge_kind", "kind", "is_conditional")) if keep_path else F.col("steps")).alias("steps"),
        )
        if mode != "all":
            rest = [c for c in step.columns if c not in (*ident, "fate")]
            order = F.struct(-F.col("confidence"), "state_conditional", "path", F.xxhash64(*rest))
            step = step.groupBy(*ident, "fate").agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*rest), order).alias("_s")).select(*ident, "fate", "_n", "_s.*")
        else:
            step = step.withColumn("_n", F.lit(1).cast("bigint"))
        step, n = counted(step.withColumn("depth", F.lit(depth)))
        if not n:
            break
        levels.append(step.groupBy(*keys, "source", "depth", "fate").agg(F.sum("_n").alias("n")))
        results.append(step.where("fate = 'sink'").drop("fate", "_n"))
        frontier = step.where("fate = 'go'").select(*start.columns)
        if max_depth is not None and depth >= max_depth:
            break
    if not results:
        none = frontier.limit(0)
        return none.withColumnRenamed("node", "sink").withColumn("depth", F.lit(0)), none.select(*keys, "source", F.lit(0).alias("depth"), F.lit("").alias("fate"), F.lit(0).cast("bigint").alias("n"))
    out = _union(results).withColumnRenamed("node", "sink")
    if max_results is not None:
        out = top_n(out, [*keys, "source"], [F.col("depth"), F.col("path")], max_results).drop("rn")
    return out, _union(levels)


def propagate_weighted(nodes: DataFrame, edges: DataFrame, sources: DataFrame, keys: list[str], effect: DataFrame | None = None, **options) -> DataFrame:
    """The results of `propagate_counted`."""
    return propagate_counted(nodes, edges, sources, keys, effect, **options)[0]


def weighted_results(results: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Result rows with reachability and flags. Flags are those of the walk before the last hop."""
    info = nodes.select(*keys, F.col("node").alias("sink"), F.col("is_in_loop").alias("sink_in_loop"))
    return results.join(info, [*keys, "sink"], "left").select(
        *keys, "source", "sink", "taint_label", "confidence", (F.col("depth") + 2).alias("path_length"),
        (~F.col("state_conditional") & (F.col("confidence") >= DEFINITE)).alias("is_definitely_reachable"),
        F.col("state_async").alias("is_async_flow"), F.col("state_partial").alias("has_partial_sanitizer"),
        F.coalesce("sink_in_loop", F.lit(False)).alias("is_in_loop"), "path", "steps")


def dedupe_weighted(results: DataFrame, keys: list[str]) -> DataFrame:
    """The best confidence per (source, sink); ties go to the shorter, then smaller path."""
    length = F.col("path_length") if "path_length" in results.columns else F.col("depth")
    return top_n(results, [*keys, "source", "sink"], [F.col("confidence").desc(), length, F.col("path")], 1).drop("rn")


def taint_edges(results: DataFrame, keys: list[str]) -> DataFrame:
    """`taints` edges source -> sink to add to the graph."""
    return results.select(
        *keys, F.col("source").alias("src"), F.col("sink").alias("dst"), F.lit("taints").alias("edge_kind"), "taint_label", "confidence")


def path_tags() -> Column:
    """Pattern tags of a result row with `steps` and flags."""
    def any_kind(*names: str) -> Column:
        return F.exists("steps", lambda s: s["kind"].isin(*names))

    return F.array_compact(F.array(
        F.when(any_kind("STRING_INTERPOLATION", "STRING_CONCAT"), "sql_via_string_interpolation"),
        F.when(F.col("is_async_flow") | any_kind("AWAIT_EXPR"), "async_taint_flow"),
        F.when(any_kind("LINQ_EXPRESSION"), "linq_taint_flow"),
        F.when(any_kind("LAMBDA_CAPTURE"), "lambda_capture_taint"),
        F.when(any_kind("COLLECTION_ITEM"), "collection_taint_flow"),
        F.when(F.col("has_partial_sanitizer"), "partial_sanitizer_bypass"),
        F.when(F.col("is_in_loop"), "sink_in_loop"),
        F.when(F.exists("steps", lambda s: s["edge_kind"] == "returned_by"), "inter_procedural_taint"),
    ))


def path_summary(results: DataFrame) -> DataFrame:
    """Adds `summary` (one text per step) and `advice` (one text per tag)."""
    steps = F.transform(
        F.arrays_zip(F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))), "steps"),
        lambda z: F.concat(
            z["0"].cast("string"), F.lit(" ["), z["steps"]["edge_kind"], F.lit("]"),
            F.when(z["steps"]["is_conditional"], " (conditional)").otherwise("")))
    advice = F.create_map(*[F.lit(x) for pair in TAG_ADVICE.items() for x in pair])
    return results.withColumn("tags", path_tags()).withColumn(
        "summary", F.array_join(F.concat(F.array(F.col("source").cast("string")), steps), " -> ")).withColumn(
        "advice", F.array_join(F.transform("tags", lambda t: F.try_element_at(advice, t)), " "))


def propagation_stats(results: DataFrame, sources: DataFrame, nodes: DataFrame, keys: list[str], levels: DataFrame | None = None) -> DataFrame:
    """Counters per graph: sources; results, their async and loop flows, partial sanitizers and flows that return from another method;
    with the levels of `propagate_counted` also the states visited (sources included), steps blocked by a sanitizer, ending in a
    cycle, too weak, cut by depth, and the deepest level."""
    def per(df: DataFrame, *aggs: Column) -> DataFrame:
        return (df.groupBy(*keys) if keys else df.groupBy(F.lit(0).alias("_g"))).agg(*aggs)

    on = keys or ["_g"]
    out = per(sources, F.count(F.lit(1)).alias("sources")).join(per(
        results, F.count(F.lit(1)).alias("results"), F.count_if("is_async_flow").alias("async_flows"), F.count_if("is_in_loop").alias("loop_flows"),
        F.count_if("has_partial_sanitizer").alias("partial_sanitizers"), F.count_if(F.exists("steps", lambda s: s["edge_kind"] == "returned_by")).alias("inter_procedural"),
        F.max("path_length").alias("longest_path")), on, "left")
    if levels is not None:
        of = lambda fate: F.coalesce(F.sum(F.when(F.col("fate") == fate, F.col("n"))), F.lit(0))
        out = out.join(per(
            levels, of("go").alias("_go"), of("blocked").alias("blocked"), of("cycle").alias("cycles"), of("weak").alias("weak"), of("deep").alias("depth_hits"),
            F.max(F.when(F.col("fate").isin("go", "sink"), F.col("depth") + 1)).alias("deepest")), on, "left")
        out = out.withColumn("visited", F.col("sources") + F.coalesce("_go", F.lit(0))).drop("_go")
    return out.na.fill(0).drop("_g")
