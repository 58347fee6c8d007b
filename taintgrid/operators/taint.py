"""Taint seeds, propagation and findings over method data-flow graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.operators.build import (
    M, Facts, block_nodes, build_dfg, clean_cfg, dfg_nodes, live_assignments, loop_nodes, method_nodes,
    methods_with_class, node_id, param_id, written,
)
from taintgrid.operators.calls import call_keys, resolve_calls
from taintgrid.operators.graph import _first_paths, all_paths_hit, closure, nearest_paths
from taintgrid.operators.lines import between_lines, near_lines
from taintgrid.operators.prefix import contains_first, prefix_first
from taintgrid.session import KEYS, checkpoint, one_per, top_n

# --- fixed values -------------------------------------------------------------------------
BODY_READERS = ["readrequestbody", "readbody", "getrequestbody"]
BODY_TEXTS = ["request.body", "request.bodyreader", "httprequest.body", "httprequest.bodyreader"]
READ_TEXTS = ["copyto", "readtoend", *BODY_TEXTS]
NO_ARGUMENT_CALLS = [
    "ExecuteReader", "ExecuteNonQuery", "ExecuteScalar", "ExecuteReaderAsync", "ExecuteNonQueryAsync", "ExecuteScalarAsync",
]
# ------------------------------------------------------------------------------------------


def _any(text: Column, words: list[str]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def source_labels(rules: DataFrame) -> DataFrame:
    """(symbol, ordinal, taint_label) of source rules: first place, last label per symbol."""
    src = rules.where("rule_type = 'source' and length(symbol) > 0")
    return src.groupBy("symbol").agg(
        F.max_by(F.coalesce("taint_label", F.lit("USER_INPUT")), "ordinal").alias("taint_label"), F.min("ordinal").alias("ordinal"))


def seed_parameters(facts: Facts, rules: DataFrame) -> DataFrame:
    """(M, node, taint_label) of parameters that carry input: entry point, HTTP binding, string in a
    controller, type holding a source name, upload type. First reason wins."""
    cls = facts["classes"].select(*KEYS, F.col("class_id").alias("containing_class_id"), C.class_flags()["is_controller"].alias("is_controller"))
    meth = facts["methods"].select(*M, "is_entry_point", "containing_class_id").join(cls, [*KEYS, "containing_class_id"], "left")
    params = contains_first(facts["parameters"], source_labels(rules), ["taint_label"], "resolved_type").join(meth, M)
    typ = F.col("resolved_type")
    label = (
        F.when(F.col("is_entry_point") | C.is_http_bound(), "USER_INPUT")
        .when(F.coalesce("is_controller", F.lit(False)) & (typ.contains("String") | typ.contains("string")), "USER_INPUT")
        .when(F.col("taint_label").isNotNull(), F.col("taint_label"))
        .when(typ.contains("IFormFile"), "USER_INPUT")
    )
    return params.select(*M, "name", label.alias("taint_label")).where("taint_label is not null").select(*M, param_id().alias("node"), "taint_label")


def seed_nodes(facts: Facts, rules: DataFrame) -> DataFrame:
    """(M, node, taint_label) of calls that return input."""
    src = method_nodes(facts).where("is_known_source and not is_known_sanitizer").select(*M, "node_id", "resolved_symbol")
    labelled = prefix_first(src, source_labels(rules), ["taint_label"])
    return labelled.select(*M, node_id().alias("node"), F.coalesce("taint_label", F.lit("USER_INPUT")).alias("taint_label"))


# --- between methods --------------------------------------------------------------------


def body_readers(facts: Facts) -> DataFrame:
    """Methods returning a string, with a return flow, that read the request body by name or text."""
    texts = method_nodes(facts).select(*M, F.lower("text").alias("t")).where(_any(F.col("t"), READ_TEXTS)).groupBy(*M).agg(
        F.bool_or(_any(F.col("t"), BODY_TEXTS)).alias("body"), F.bool_or(_any(F.col("t"), READ_TEXTS)).alias("reads"))
    name = F.lower(F.trim("name"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    hit = name.isin(*BODY_READERS) | (name.contains("read") & name.contains("body") & yes("reads")) | yes("body")
    meth = facts["methods"].where(F.lower("return_type").isin("string", "system.string"))
    return meth.join(texts, M, "left").where(hit).join(facts["return_flows"].select(*M).distinct(), M, "left_semi").select(*M)


def returning_symbols(facts: Facts) -> DataFrame:
    """(M, resolved_symbol): symbols of calls a method returns, or makes within 8 lines of a returned node."""
    calls = method_nodes(facts).where("kind = 'InvocationExpression' and resolved_symbol is not null")
    returned = facts["return_flows"].select(*M, F.explode("returned_node_ids").alias("node_id"))
    direct = calls.join(returned, [*M, "node_id"], "left_semi").select(*M, "resolved_symbol")
    lines = returned.join(facts["nodes"].select(*KEYS, "node_id", F.col("line").alias("line_b")), [*KEYS, "node_id"]).select(*M, "line_b").distinct()
    # the returned lines are fewer than the calls, so they are the side that is copied
    close = near_lines(lines, calls.select(*M, "resolved_symbol", F.col("line").alias("line_a")), 8, M, "line_b", "line_a").select(*M, "resolved_symbol")
    return direct.union(close).distinct()


def returning_edges(facts: Facts) -> DataFrame:
    """(keys, src, dst): from a method, `m:` and its id, over its name, `k:` and the key that symbols have for it, to the methods that
    return a call of that name. Methods of one name and their callers meet at the name, so they aren't paired."""
    kept = checkpoint(returning_symbols(facts))
    left, right = call_keys(kept, facts["methods"])
    methods = right.select(*KEYS, F.concat(F.lit("m:"), "method_id").alias("src"), F.concat(F.lit("k:"), "_key").alias("dst"))
    called = left.join(checkpoint(right.select(*KEYS, "_key").distinct()), [*KEYS, "_key"])
    callers = kept.join(called, [*KEYS, "resolved_symbol"]).select(
        *KEYS, F.concat(F.lit("k:"), "_key").alias("src"), F.concat(F.lit("m:"), "method_id").alias("dst"))
    return methods.unionByName(callers)


def tainted_returns(facts: Facts) -> DataFrame:
    """Methods whose return value may be tainted: flagged ones, helpers that read the request body
    (where the scan has a flagged one), and, to a fixed point, methods that return their calls."""
    seeds = facts["return_flows"].where("may_return_tainted").select(*M).distinct()
    helpers = body_readers(facts).join(seeds.select(*KEYS).distinct(), KEYS, "left_semi")
    start = seeds.union(helpers).distinct().select(*KEYS, F.concat(F.lit("m:"), "method_id").alias("node"))
    return closure(returning_edges(facts), start, KEYS).where("startswith(node, 'm:')").select(*KEYS, F.expr("substring(node, 3)").alias("method_id"))


def calls_into(facts: Facts, methods: DataFrame) -> DataFrame:
    """(keys, resolved_symbol, callee_method_id): the first of `methods` each symbol names."""
    table = facts["methods"].join(methods.select(*M).distinct(), M, "left_semi")
    return resolve_calls(method_nodes(facts).where("kind = 'InvocationExpression'"), table)


def tainted_callee_params(facts: Facts, returns: DataFrame) -> DataFrame:
    """(M, parameter_name): parameters that receive a tainted argument at some call."""
    calls = facts["nodes"].where("kind = 'InvocationExpression' and resolved_symbol is not null")
    args = calls.select(*KEYS, "resolved_symbol", F.explode("arguments").alias("a")).select(
        *KEYS, "resolved_symbol", "a.position", "a.origin_node_id", C.may_be_tainted(F.col("a")).alias("hot"))
    hot_calls = calls.join(calls_into(facts, returns), [*KEYS, "resolved_symbol"], "left_semi").select(
        *KEYS, F.col("node_id").alias("origin_node_id"), F.lit(True).alias("from_hot"))
    hot = args.join(hot_calls, [*KEYS, "origin_node_id"], "left").where(F.col("hot") | F.coalesce("from_hot", F.lit(False)))
    to = hot.select(*KEYS, "resolved_symbol", "position").distinct().join(resolve_calls(calls, facts["methods"]), [*KEYS, "resolved_symbol"])
    return to.withColumnRenamed("callee_method_id", "method_id").join(
        facts["parameters"].select(*M, "position", F.col("name").alias("parameter_name")), [*M, "position"]).select(*M, "parameter_name").distinct()


# --- inside a method --------------------------------------------------------------------


def propagate(edges: DataFrame, seeds: DataFrame, blocked: DataFrame) -> DataFrame:
    """(M, node, depth): nodes reached from the seeds; blocked nodes are not entered or passed."""
    return closure(edges, seeds.select(*M, "node"), M, blocked=blocked)


def tainted_sinks(tainted: DataFrame, sinks: DataFrame) -> DataFrame:
    return sinks.join(tainted.select(*M, "node").distinct(), [*M, "node"], "left_semi")


def nearest_origin(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(M, node, source, path): the nearest seed of every node over all edges, and the path from it.

    All seeds spread at once and each node keeps one path, so a hot method costs its nodes, not
    its sources times its sinks. Ties go to the smallest path.
    """
    found = _first_paths(checkpoint(edges.select(*M, "src", "dst").distinct()), seeds.select(*M, "node"), M)
    return found.select(*M, "node", F.col("path")[0].alias("source"), "path")


def has_host_whitelist(nodes: DataFrame) -> DataFrame:
    """Methods that compare a host and mention a whitelist."""
    t = F.lower("text")
    host = t.contains(".host") & (t.contains("contains(") | t.contains("indexof("))
    hint = t.contains("whitelist") | t.contains("allowedhost")
    return nodes.where(host | hint).groupBy(*M).agg(F.bool_or(host).alias("h"), F.bool_or(hint).alias("w")).where("h and w").select(*M)


FINDING = [
    *M, "source_node_id", "sink_node_id", "vulnerability_kind", "confidence", "source_file", "source_line", "source_label",
    "taint_label", "sink_symbol", "sink_file", "sink_line", "sink_label", "sink_arg_position", "method_name", "class_name",
    "path", "has_partial_sanitizer", "sanitizer_symbol", "is_definitely_reachable", "is_in_loop", "phase",
]


def sink_label() -> Column:
    return F.concat("text", F.lit(" ["), F.coalesce(C.last_segment("resolved_symbol"), F.lit("")), F.lit("]"))


def _kinds(df: DataFrame, sink_kinds: DataFrame, symbol: str = "resolved_symbol") -> DataFrame:
    return prefix_first(df, sink_kinds, ["vulnerability_kind"], symbol).na.fill("UNKNOWN", ["vulnerability_kind"])


def _names(df: DataFrame, facts: Facts) -> DataFrame:
    return df.join(methods_with_class(facts).select(*M, F.col("name").alias("method_name"), "class_name"), M)


def taint_seeds(facts: Facts, rules: DataFrame, callee_params: DataFrame) -> DataFrame:
    """All seeds of a scan; a parameter tainted only by its callers gets USER_INPUT."""
    own = seed_parameters(facts, rules)
    fed = callee_params.select(*M, param_id(name="parameter_name").alias("node"), F.lit("USER_INPUT").alias("taint_label"))
    # only the first parameter of that name in the method is a graph node
    fed = fed.join(own, [*M, "node"], "left_anti")
    every = own.unionByName(fed).unionByName(seed_nodes(facts, rules))
    return one_per(every, [*M, "node"])


def flow_findings(facts: Facts, rules: DataFrame, sink_kinds: DataFrame, edges: DataFrame, seeds: DataFrame, max_path_edges: int | None = None) -> DataFrame:
    """Tainted sinks inside methods, with origin, path, loop flag and confidence. With max_path_edges, a longer path is
    left out of the row and rated as unknown."""
    sem = method_nodes(facts)
    cleaners = sem.where("is_known_sanitizer").select(*M, node_id().alias("node"), "node_id", "line", "ordinal", "resolved_symbol")
    sinks = sem.where(F.col("is_known_sink") & ~C.first_arg_is_literal()).select(
        *M, node_id().alias("node"), "node_id", "file", "line", "text", "resolved_symbol", C.tainted_position().alias("sink_arg_position"))
    found = nearest_paths(edges, seeds, sinks, cleaners, M).select(*M, "node", F.col("path")[0].alias("source"), "path")
    hit = _kinds(sinks.join(found, [*M, "node"]), sink_kinds)
    guard = has_host_whitelist(sem).withColumn("_safe", F.lit(True))
    hit = hit.join(guard, M, "left").where((F.col("vulnerability_kind") != "SSRF") | F.col("_safe").isNull()).drop("_safe")
    info = dfg_nodes(facts).select(
        *M, F.col("node").alias("source"), F.col("kind").alias("source_kind"), F.col("file").alias("source_file"),
        F.col("line").alias("source_line"), F.col("label").alias("source_text"))
    hit = checkpoint(hit.join(info, [*M, "source"]).join(
        seeds.select(*M, F.col("node").alias("source"), "taint_label"), [*M, "source"]))
    hit = hit.join(sanitised_pairs(facts, hit, cleaners), [*M, "source", "node"], "left_anti")
    loops = loop_nodes(_cfg_of(facts, hit)).withColumn("_loop", F.lit(True))
    partial = cleaners.groupBy(*M).agg(F.min_by("resolved_symbol", "ordinal").alias("sanitizer_symbol")).withColumn("_part", F.lit(True))
    out = hit.join(loops, [*M, "node"], "left").join(partial, M, "left")
    is_param = F.col("source_kind") == "PARAMETER"
    length = F.size("path") if max_path_edges is None else F.when(F.size("path") - 1 <= max_path_edges, F.size("path")).otherwise(0)
    param_label = F.concat(
        F.lit("parameter '"), F.element_at(F.split("source", ":"), -1), F.lit("' of "), F.col("method_name"), F.lit("()"))
    return _names(out, facts).select(
        *M, F.col("source").alias("source_node_id"), F.col("node").alias("sink_node_id"), "vulnerability_kind",
        C.path_confidence(length, is_param).alias("confidence"), "source_file", "source_line",
        F.when(is_param, param_label).otherwise(F.col("source_text")).alias("source_label"), "taint_label",
        F.col("resolved_symbol").alias("sink_symbol"), F.col("file").alias("sink_file"), F.col("line").alias("sink_line"),
        sink_label().alias("sink_label"), "sink_arg_position", "method_name", "class_name",
        F.when(length > 0, F.col("path")).otherwise(F.expr("cast(array() as array<string>)")).alias("path"),
        F.coalesce("_part", F.lit(False)).alias("has_partial_sanitizer"), "sanitizer_symbol",
        F.lit(True).alias("is_definitely_reachable"), F.coalesce("_loop", F.lit(False)).alias("is_in_loop"),
        F.lit(1).alias("phase"),
    )


def _cfg_of(facts: Facts, rows: DataFrame) -> Facts:
    """The control flow of the methods of rows."""
    methods = checkpoint(rows.select(*M).distinct())
    return {name: facts[name].join(methods, M, "left_semi") for name in ("cfg_blocks", "cfg_edges")}


def sanitised_pairs(facts: Facts, hits: DataFrame, cleaners: DataFrame) -> DataFrame:
    """(M, source, node) pairs whose every control-flow path meets a sanitizer block. A method without
    blocks falls back to a sanitizer line between the two lines. A parameter has no block."""
    # methods without a sanitizer have no such pair: they are left out of every step
    pairs = hits.select(*M, "source", "node", "source_line", F.col("line").alias("sink_line")).distinct().join(
        cleaners.select(*M).distinct(), M, "left_semi")
    pairs = checkpoint(pairs)
    facts = _cfg_of(facts, pairs)
    with_cfg = facts["cfg_blocks"].select(*M).distinct()
    by_line = between_lines(pairs.join(with_cfg, M, "left_anti"), cleaners, M, ["source", "node", *M], "source_line", "sink_line")
    at = checkpoint(block_nodes(facts).select(*M, node_id().alias("node"), "block_id"))
    located = pairs.select(*M, "source", "node").join(at.select(*M, F.col("node").alias("source"), F.col("block_id").alias("sb")), [*M, "source"]).join(
        at.withColumnRenamed("block_id", "tb"), [*M, "node"])
    marked = cleaners.select(*M, "node").join(at, [*M, "node"]).select(*M, F.col("block_id").alias("node")).distinct()
    # methods without a marked block cannot be sanitised: leave them out of the walk
    located = checkpoint(located.join(marked.select(*M).distinct(), M, "left_semi"))
    edges = clean_cfg(facts)[1].join(located.select(*M).distinct(), M, "left_semi")
    blocks = located.select(*M, F.col("sb").alias("source"), F.col("tb").alias("target")).distinct()
    safe = all_paths_hit(edges, blocks, marked, M).where("is_hit").select(*M, F.col("source").alias("sb"), F.col("target").alias("tb"))
    by_path = located.join(safe, [*M, "sb", "tb"], "left_semi")
    return by_path.select(*M, "source", "node").unionByName(by_line.select(*M, "source", "node"))


def interproc_findings(facts: Facts, returns: DataFrame, sink_kinds: DataFrame) -> DataFrame:
    """A call of a tainted-return method whose value a sink of the same method takes: as argument
    origin, or as a return value within 5 lines."""
    sem = method_nodes(facts)
    calls = sem.where("kind = 'InvocationExpression' and resolved_symbol is not null").join(calls_into(facts, returns), [*KEYS, "resolved_symbol"])
    calls = calls.select(*M, F.col("node_id").alias("call_id"), F.col("line").alias("line_a"), F.col("file").alias("call_file"), "callee_method_id")
    sinks = sem.where("is_known_sink")
    by_origin = sinks.select(*M, "node_id", F.explode("arguments").alias("a")).select(*M, "node_id", F.col("a.origin_node_id").alias("call_id"))
    near = near_lines(
        calls.select(*M, "call_id", "line_a"),
        sinks.where(F.exists("arguments", lambda a: a["data_flow_origin"] == "return_value")).select(*M, "node_id", F.col("line").alias("line_b")), 5, M)
    pairs = by_origin.join(calls.select(*M, "call_id"), [*M, "call_id"], "left_semi").select(*M, "call_id", "node_id").union(
        near.select(*M, "call_id", "node_id")).distinct()
    full = _kinds(pairs.join(calls, [*M, "call_id"]).join(
        sinks.select(*M, "node_id", "file", "line", "text", "resolved_symbol"), [*M, "node_id"]), sink_kinds)
    callee = facts["methods"].select(*KEYS, F.col("method_id").alias("callee_method_id"), F.col("name").alias("callee_name"))
    full = full.join(callee, [*KEYS, "callee_method_id"])
    return _names(full, facts).select(
        *M, node_id("call_id").alias("source_node_id"), node_id().alias("sink_node_id"), "vulnerability_kind", F.lit("medium").alias("confidence"),
        F.col("call_file").alias("source_file"), F.col("line_a").alias("source_line"),
        F.concat("callee_name", F.lit("() [returns tainted]")).alias("source_label"), F.lit("USER_INPUT").alias("taint_label"),
        F.col("resolved_symbol").alias("sink_symbol"), F.col("file").alias("sink_file"), F.col("line").alias("sink_line"),
        sink_label().alias("sink_label"), F.lit(None).cast("int").alias("sink_arg_position"), "method_name", "class_name",
        F.expr("cast(array() as array<string>)").alias("path"), F.lit(False).alias("has_partial_sanitizer"),
        F.lit(None).cast("string").alias("sanitizer_symbol"), F.lit(False).alias("is_definitely_reachable"),
        F.lit(False).alias("is_in_loop"), F.lit(2).alias("phase"),
    )


def string_injection(facts: Facts, sink_kinds: DataFrame) -> DataFrame:
    """Strings built from variables at most 10 lines from an SQL or command sink they flow to, with no
    sanitizer between build and sink."""
    sem = method_nodes(facts)
    builds = live_assignments(facts).where(C.string_build_has_variable("source_text") & C.is_string_concat("source_text")).select(
        *M, "assignment_id", "target_name", "source_text", F.col("line").alias("line_a"))
    bare = (F.size("arguments") <= 0) & C.last_segment("resolved_symbol").isin(*NO_ARGUMENT_CALLS)
    sinks = sem.where(F.col("is_known_sink") & ~C.sink_is_literal() & ~F.coalesce(bare, F.lit(False))).select(
        *M, "node_id", "file", "text", "resolved_symbol", "arguments", F.col("line").alias("line_b"))
    sinks = _kinds(sinks, sink_kinds).where("vulnerability_kind in ('SQL_INJECTION', 'COMMAND_INJECTION')")
    pairs = near_lines(builds, sinks, 10, M).where(C.build_flows_to_sink("target_name")).drop("arguments")
    free = between_lines(pairs, sem.where("is_known_sanitizer"), M, [*M, "assignment_id", "node_id"], "line_a", "line_b", anti=True)
    return _names(free, facts).select(
        *M, F.concat(F.lit("a:"), "assignment_id").alias("source_node_id"), node_id().alias("sink_node_id"), "vulnerability_kind",
        F.lit("high").alias("confidence"), F.col("file").alias("source_file"), F.col("line_a").alias("source_line"),
        F.concat(F.lit("String building: "), "source_text").alias("source_label"), F.lit("USER_INPUT").alias("taint_label"),
        F.col("resolved_symbol").alias("sink_symbol"), F.col("file").alias("sink_file"), F.col("line_b").alias("sink_line"),
        sink_label().alias("sink_label"), F.lit(None).cast("int").alias("sink_arg_position"), "method_name", "class_name",
        F.expr("cast(array() as array<string>)").alias("path"), F.lit(False).alias("has_partial_sanitizer"),
        F.lit(None).cast("string").alias("sanitizer_symbol"), F.lit(True).alias("is_definitely_reachable"),
        F.lit(False).alias("is_in_loop"), F.lit(3).alias("phase"),
    )


def dedupe_taint(findings: DataFrame) -> DataFrame:
    """The best confidence per (source, sink); on ties the earlier phase."""
    order = [C.confidence_rank(), F.col("phase"), F.col("vulnerability_kind"), F.xxhash64(*findings.columns)]
    return top_n(findings, [*KEYS, "source_node_id", "sink_node_id"], order, 1).drop("rn")


def taint_findings(facts: Facts, rules: DataFrame, sink_kinds: DataFrame) -> DataFrame:
    """All taint findings: inside methods, between methods, string building; deduplicated."""
    facts = written(facts)
    returns = checkpoint(tainted_returns(facts))
    edges = checkpoint(build_dfg(facts).select(*M, "src", "dst"))
    seeds = checkpoint(taint_seeds(facts, rules, tainted_callee_params(facts, returns)))
    known = dfg_nodes(facts).select(*M, "node")
    seeds = seeds.join(known, [*M, "node"], "left_semi")
    parts = flow_findings(facts, rules, sink_kinds, edges, seeds).unionByName(
        interproc_findings(facts, returns, sink_kinds)).unionByName(string_injection(facts, sink_kinds))
    return dedupe_taint(parts)


def taint_paths(findings: DataFrame, facts: Facts, seeds: DataFrame) -> DataFrame:
    """One row per path step: step_no, node, step kind, label, file, line, label of the taint."""
    steps = findings.select(*M, "source_node_id", "sink_node_id", F.posexplode("path").alias("step_no", "node"))
    info = dfg_nodes(facts).select(*M, "node", "kind", "label", "file", "line")
    marked = steps.join(info, [*M, "node"]).join(seeds.select(*M, "node", F.col("taint_label").alias("_seed")), [*M, "node"], "left")
    kind = (
        F.when(F.col("_seed").isNotNull(), "source").when(F.col("node") == F.col("sink_node_id"), "sink")
        .when(F.col("kind").isin("ASSIGNMENT", "STRING_BUILD"), "assignment").when(F.col("kind") == "LAMBDA_CAPTURE", "lambda_capture")
        .otherwise("call")
    )
    return marked.select(
        *M, "source_node_id", "sink_node_id", "step_no", "node", kind.alias("step_kind"), "label", "file", "line",
        F.coalesce("_seed", F.lit("USER_INPUT")).alias("taint_label"))
