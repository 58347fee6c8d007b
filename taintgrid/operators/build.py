"""Data-flow and unified graphs from fact tables: one function per edge rule.

Node ids: `p:<method>:<parameter>`, `n:<node>`, `a:<assignment>`. All edges of a rule stay in one
method unless said otherwise; columns are KEYS, method_id, src, dst, edge_kind, arg_position, via.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.operators.calls import call_keys, resolve_calls
from taintgrid.operators.grams import contains_pairs
from taintgrid.operators.graph import closure, cycle_nodes
from taintgrid.operators.lines import between_lines, near_lines
from taintgrid.operators.state import union
from taintgrid.session import KEYS, checkpoint

M = [*KEYS, "method_id"]
EDGE = [*M, "src", "dst", "edge_kind", "arg_position", "via"]
FEW_SOURCES = 32  # a method with more has its texts searched by grams

Facts = dict[str, DataFrame]


def param_id(method: str | Column = "method_id", name: str | Column = "name") -> Column:
    return F.concat_ws(":", F.lit("p"), method, name)


def node_id(name: str = "node_id") -> Column:
    return F.concat(F.lit("n:"), F.col(name))


def assign_id(name: str = "assignment_id") -> Column:
    return F.concat(F.lit("a:"), F.col(name))


def _edges(
    df: DataFrame, src: Column, dst: Column, kind: str, pos: Column | None = None, via: Column | None = None, **more: Column | str,
) -> DataFrame:
    """Edges, with further columns by name that a check of theirs reads."""
    return df.select(
        *M, src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_kind"),
        (F.lit(None) if pos is None else pos).cast("int").alias("arg_position"),
        (F.lit(None) if via is None else via).cast("string").alias("via"),
        *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in more.items()],
    )


class Written(dict):
    """Facts whose nodes are a written table."""


def written(facts: Facts) -> Written:
    """The facts with their nodes written once, for steps that read them many times."""
    return facts if isinstance(facts, Written) else Written({**facts, "nodes": checkpoint(facts["nodes"])})


def method_nodes(facts: Facts) -> DataFrame:
    return facts["nodes"].where("containing_method_id is not null").withColumnRenamed("containing_method_id", "method_id")


def live_assignments(facts: Facts) -> DataFrame:
    return facts["assignments"].where("not is_literal").withColumnRenamed("containing_method_id", "method_id")


def arguments(nodes: DataFrame) -> DataFrame:
    """One row per argument, with `arg_index` in list order and the argument's fields."""
    keep = [c for c in (*M, "node_id", "line", "ordinal", "is_known_sink", "is_known_sanitizer") if c in nodes.columns]
    return nodes.select(
        *keep, C.first_arg_is_literal().alias("first_literal"), F.posexplode("arguments").alias("arg_index", "arg")
    ).select(*keep, "first_literal", "arg_index", "arg.*")


def last_assignments(facts: Facts) -> DataFrame:
    """The last non-literal assignment of each variable in a method."""
    best = F.max_by(F.struct("assignment_id", "line"), "ordinal").alias("_a")
    return live_assignments(facts).groupBy(*M, "target_name").agg(best).select(
        *M, "target_name", "_a.assignment_id", F.col("_a.line").alias("asgn_line")
    )


def _of_parameters(facts: Facts, some: DataFrame) -> DataFrame:
    """Edges whose `_name` is a parameter of the method. Not a semi join, which Spark would split over the rules again."""
    return some.join(facts["parameters"].select(*M, F.col("name").alias("_name")).distinct(), [*M, "_name"]).drop("_name")


def _at_nodes(facts: Facts, some: DataFrame) -> DataFrame:
    """Edges whose `_node` is a node of the method."""
    return some.join(method_nodes(facts).select(*M, F.col("node_id").alias("_node")).distinct(), [*M, "_node"]).drop("_node")


def _uses(facts: Facts) -> DataFrame:
    used = facts["param_flows"].select(*M, "parameter_name", F.explode("used_in_node_ids").alias("node_id"))
    return _edges(used, param_id(name="parameter_name"), node_id(), "flows_to", _name="parameter_name", _node="node_id")


def edges_param_use(facts: Facts) -> DataFrame:
    """Parameter to each node that uses it."""
    return _at_nodes(facts, _of_parameters(facts, _uses(facts)))


def _feeds(facts: Facts) -> DataFrame:
    asg = live_assignments(facts).select(*M, "assignment_id", F.col("source_node_id").alias("node_id"))
    return _edges(asg, node_id(), assign_id(), "assigned_to", _node="node_id")


def edges_node_to_assignment(facts: Facts) -> DataFrame:
    """Source node to the assignment it feeds."""
    return _at_nodes(facts, _feeds(facts))


def _aliases(facts: Facts) -> DataFrame:
    flows = facts["param_flows"].select(*M, "parameter_name", F.explode("assigned_to_ids").alias("source_node_id"))
    hit = flows.join(live_assignments(facts).select(*M, "source_node_id", "assignment_id"), [*M, "source_node_id"])
    return _edges(hit, param_id(name="parameter_name"), assign_id(), "aliases", _name="parameter_name")


def edges_param_alias(facts: Facts) -> DataFrame:
    """Parameter to the assignments fed by the nodes it was assigned to."""
    return _of_parameters(facts, _aliases(facts))


def edges_local_use(facts: Facts) -> DataFrame:
    """Last assignment of a local to the nodes that take it as argument."""
    args = arguments(method_nodes(facts)).where("data_flow_origin = 'local_variable'")
    hit = args.select(*M, "node_id", "position", F.col("text").alias("target_name")).join(last_assignments(facts), [*M, "target_name"])
    return _edges(hit, assign_id(), node_id(), "flows_to", F.col("position"), F.col("target_name"))


def edges_string_build(facts: Facts) -> DataFrame:
    """String build to sinks at most two lines away, unless the sink's first argument is literal."""
    builds = live_assignments(facts).where("target_name in ('__interpolated_string', '__string_concat')").select(
        *M, "assignment_id", F.col("line").alias("line_a"))
    sinks = method_nodes(facts).where(F.col("is_known_sink") & ~C.first_arg_is_literal()).select(*M, "node_id", F.col("line").alias("line_b"))
    return _edges(near_lines(builds, sinks, 2, M), assign_id(), node_id(), "flows_to")


def _straight(facts: Facts) -> DataFrame:
    args = arguments(method_nodes(facts)).where("not is_literal and data_flow_origin = 'parameter'")
    return _edges(args, param_id(name="origin_parameter_name"), node_id(), "flows_to", F.col("position"), _name="origin_parameter_name")


def edges_param_arg(facts: Facts) -> DataFrame:
    """Parameter to node when an argument comes straight from it."""
    return _of_parameters(facts, _straight(facts))


def _members(facts: Facts) -> DataFrame:
    args = arguments(method_nodes(facts)).where("not is_literal and data_flow_origin = 'field'").withColumn("base", C.field_base("text"))
    return _edges(args, param_id(name="base"), node_id(), "flows_to", F.col("position"), F.col("text"), _name="base")


def edges_param_field(facts: Facts) -> DataFrame:
    """Parameter to node when an argument is a member of it."""
    return _of_parameters(facts, _members(facts))


def _returned(facts: Facts) -> DataFrame:
    args = arguments(method_nodes(facts)).where("not is_literal and data_flow_origin = 'return_value'")
    return _edges(args, node_id("origin_node_id"), node_id(), "flows_to", F.col("position"), _node="origin_node_id")


def edges_return_value(facts: Facts) -> DataFrame:
    """Node to node when an argument is the other node's return value."""
    return _at_nodes(facts, _returned(facts))


def edges_source_text(facts: Facts, head: int | None = None) -> DataFrame:
    """Source node to assignments on its line, or whose text holds the source's text (or its first `head`
    characters if given); an empty text is held by none."""
    sources = method_nodes(facts).where("is_known_source").select(*M, "node_id", "line", C.short("text", head).alias("piece"))
    asg = live_assignments(facts).select(*M, "assignment_id", "line", "source_text")
    # with few sources a method's assignments meet each of them at once; only the texts of other methods are cut into grams
    many = checkpoint(sources.groupBy(*M).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW_SOURCES).drop("_n"))
    if many.isEmpty():
        return _meet_sources(asg, sources)
    of_many = _search_sources(asg.join(many, M, "left_semi"), sources.join(many, M, "left_semi"))
    return _meet_sources(asg, sources.join(many, M, "left_anti")).unionByName(of_many)


def _meet_sources(asg: DataFrame, sources: DataFrame) -> DataFrame:
    """`edges_source_text` by one join on the method: every assignment meets every source of its method."""
    at = sources.withColumnRenamed("line", "line_s")
    held = (F.length("piece") > 0) & F.contains("source_text", "piece")
    hit = asg.join(at, M).where((F.col("line") == F.col("line_s")) | held)
    return _edges(hit, node_id(), assign_id(), "flows_to").distinct()


def _search_sources(asg: DataFrame, sources: DataFrame) -> DataFrame:
    """`edges_source_text` without pairs of a whole method: texts are found by the rarest gram of each source."""
    same_line = _edges(sources.join(asg, [*M, "line"]), node_id(), assign_id(), "flows_to")
    held = contains_pairs(asg, sources, M, "source_text", "piece")
    inside = held.join(sources, [*M, "piece"]).join(asg, [*M, "source_text"])
    return same_line.unionByName(_edges(inside, node_id(), assign_id(), "flows_to")).distinct()


def edges_variable_to_sink(facts: Facts) -> DataFrame:
    """Last assignment of a variable to sinks that take it by name, unless a sanitizer on that
    variable lies between the two lines or the sink's first argument is literal."""
    args = arguments(method_nodes(facts)).where("not is_literal")
    sinks = args.where("is_known_sink and not first_literal").select(*M, "node_id", "line", F.col("text").alias("target_name")).distinct()
    cleaned = args.where("is_known_sanitizer").select(*M, F.col("text").alias("target_name"), "line")
    pairs = sinks.join(last_assignments(facts), [*M, "target_name"])
    free = between_lines(pairs, cleaned, [*M, "target_name"], [*M, "assignment_id", "node_id"], "asgn_line", "line", anti=True)
    return _edges(free, assign_id(), node_id(), "flows_to", None, F.col("target_name"))


# In the order the rules are applied; a later rule's edge replaces an earlier one between the same
# two nodes. The last rule only adds edges that are not there yet, so it ranks first.
RULES = {
    "variable_to_sink": edges_variable_to_sink, "param_use": edges_param_use, "node_to_assignment": edges_node_to_assignment,
    "param_alias": edges_param_alias, "local_use": edges_local_use, "string_build": edges_string_build,
    "param_arg": edges_param_arg, "param_field": edges_param_field, "return_value": edges_return_value,
    "source_text": edges_source_text,
}


# Rules whose edges are checked against the parameters or the nodes of their methods; each check is one join for all its rules.
OF_PARAMETERS = {"param_alias": _aliases, "param_arg": _straight, "param_field": _members}
AT_NODES = {"node_to_assignment": _feeds, "return_value": _returned}


def build_dfg(facts: Facts) -> DataFrame:
    """All data-flow edges, one per (src, dst)."""
    place = {name: F.lit(i).alias("_rule") for i, name in enumerate(RULES)}
    named = lambda rules: [rule(facts).select("*", place[name]) for name, rule in rules.items()]
    used = _of_parameters(facts, _uses(facts)).select("*", place["param_use"])
    whole = {n: rule for n, rule in RULES.items() if n not in (*OF_PARAMETERS, *AT_NODES, "param_use")}
    out = union([_of_parameters(facts, union(named(OF_PARAMETERS))), _at_nodes(facts, union([used, *named(AT_NODES)])), *named(whole)])
    rest = F.struct("edge_kind", "arg_position", "via")
    order = F.struct("_rule", F.coalesce("arg_position", F.lit(-1)), F.coalesce("via", F.lit("")))
    return out.groupBy(*M, "src", "dst").agg(F.max_by(rest, order).alias("_e")).select(*M, "src", "dst", "_e.*")


def dfg_nodes(facts: Facts) -> DataFrame:
    """(M, node, kind, label, line, file, flags) for parameters, semantic nodes and assignments."""
    flags = lambda *on: [F.lit(f in on).alias(f) for f in ("is_known_sink", "is_known_source", "is_known_sanitizer")]
    meth = facts["methods"].select(*M, F.col("name").alias("method_name"), "file", "line_start")
    params = facts["parameters"].join(meth, M).select(
        *M, param_id().alias("node"), F.lit("PARAMETER").alias("kind"),
        F.concat_ws(".", "method_name", "name").alias("label"), F.col("line_start").alias("line"), "file", *flags())
    sem = method_nodes(facts).select(
        *M, node_id().alias("node"), F.lit("SEMANTIC_NODE").alias("kind"), F.col("text").alias("label"), "line", "file",
        "is_known_sink", "is_known_source", "is_known_sanitizer")
    asg = live_assignments(facts).select(
        *M, assign_id().alias("node"), C.dfg_node_kind().alias("kind"),
        F.concat(F.col("target_name"), F.lit(" = "), "source_text").alias("label"), "line",
        F.lit("").alias("file"), *flags())
    return params.unionByName(sem).unionByName(asg)


# --- between methods --------------------------------------------------------------------


def methods_with_class(facts: Facts) -> DataFrame:
    cls = facts["classes"].select(*KEYS, F.col("class_id").alias("containing_class_id"), F.col("name").alias("class_name"))
    return facts["methods"].join(cls, [*KEYS, "containing_class_id"], "left")


def edges_interprocedural(facts: Facts) -> DataFrame:
    """`r:<callee>` to `c:<node>` when the callee (Class.method suffix) may return tainted data."""
    called = resolve_calls(method_nodes(facts), methods_with_class(facts), "suffix")
    risky = facts["return_flows"].where("may_return_tainted").select(*KEYS, F.col("method_id").alias("callee_method_id")).distinct()
    hit = method_nodes(facts).join(called.join(risky, [*KEYS, "callee_method_id"], "left_semi"), [*KEYS, "resolved_symbol"])
    return _edges(hit, F.concat(F.lit("r:"), "callee_method_id"), F.concat(F.lit("c:"), "node_id"), "returned_by", None, F.col("callee_method_id"))


def edges_returned_by(facts: Facts) -> DataFrame:
    """Returned node to every caller whose symbol contains the method name; confidence 0.85."""
    calls = method_nodes(facts).where("kind = 'InvocationExpression'")
    names = checkpoint(facts["methods"].where(F.length("name") > 0).select(*KEYS, "name").distinct())
    left, right = call_keys(calls, names, "loose")
    named = left.join(right, [*KEYS, "_key"]).select(*KEYS, "resolved_symbol", "name")
    callers = calls.select(*M, "node_id", "resolved_symbol").join(named, [*KEYS, "resolved_symbol"]).groupBy(*M, "node_id").agg(
        F.collect_set("name").alias("_names"))
    known = facts["nodes"].select(*KEYS, F.col("node_id").alias("ret_id"))
    of_method = facts["methods"].where(F.length("name") > 0).select(*KEYS, "method_id", "name")
    returned = facts["return_flows"].select(*KEYS, "method_id", F.explode("returned_node_ids").alias("ret_id")).join(
        known, [*KEYS, "ret_id"], "left_semi").join(of_method, [*KEYS, "method_id"]).groupBy(*KEYS, "ret_id").agg(F.collect_set("name").alias("_of"))
    # calls and returned nodes meet by name in the last join, so no pair is moved; of several names they share the smallest counts
    hit = callers.withColumn("name", F.explode("_names")).join(returned.withColumn("name", F.explode("_of")), [*KEYS, "name"]).where(
        (F.size("_of") == 1) | (F.col("name") == F.array_min(F.array_intersect("_of", "_names"))))
    return _edges(hit, node_id("ret_id"), node_id(), "returned_by")


def unified_graph(facts: Facts, strict_compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the property graph. With strict_compat, edges at assignments are dropped."""
    meth = methods_with_class(facts).select(*M, F.col("name").alias("method_name"), F.col("file").alias("method_file"), "line_start", "class_name")
    blank = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    no = lambda name: F.lit(False).alias(name)
    tail = ["is_async", "is_source", "is_sink", "is_sanitizer"]
    sem = facts["nodes"].withColumnRenamed("containing_method_id", "method_id").join(meth.select(*M, "class_name"), M, "left").select(
        *M, node_id().alias("node"), C.graph_node_kind().alias("kind"), F.col("text").alias("label"), "file", "line",
        "class_name", "resolved_symbol", F.col("is_async_call").alias("is_async"), F.col("is_known_source").alias("is_source"),
        F.col("is_known_sink").alias("is_sink"), F.col("is_known_sanitizer").alias("is_sanitizer"))
    params = facts["parameters"].join(meth, M).select(
        *M, param_id().alias("node"), F.lit("PARAMETER").alias("kind"),
        F.concat(F.concat_ws(".", "method_name", "name"), F.lit(":"), C.last_segment("resolved_type")).alias("label"),
        F.col("method_file").alias("file"), F.col("line_start").alias("line"), "class_name", blank("resolved_symbol"), *[no(t) for t in tail])
    asg = live_assignments(facts).join(meth, M, "left").select(
        *M, assign_id().alias("node"), C.graph_assignment_kind().alias("kind"),
        F.concat(F.col("target_name"), F.lit(" = "), "source_text").alias("label"),
        F.coalesce("method_file", F.lit("")).alias("file"), "line", blank("class_name"), blank("resolved_symbol"), *[no(t) for t in tail])
    flow = build_dfg(facts)
    if strict_compat:
        flow = flow.where(~F.col("src").startswith("a:") & ~F.col("dst").startswith("a:"))
    edges = flow.withColumn("confidence", F.lit(1.0)).unionByName(edges_returned_by(facts).withColumn("confidence", F.lit(0.85)))
    return sem.unionByName(params).unionByName(asg), edges.withColumn("is_conditional", F.lit(False))


# --- control flow -----------------------------------------------------------------------


def clean_cfg(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """(blocks, edges): edges with an unknown end dropped; a method without entry enters at its first block."""
    blocks = facts["cfg_blocks"]
    first = blocks.groupBy(*M).agg(
        F.coalesce(F.min_by("block_id", F.when(F.col("is_entry"), F.col("block_no"))), F.min_by("block_id", "block_no")).alias("_first"))
    blocks = blocks.join(first, M).withColumn("is_entry", F.col("block_id") == F.col("_first")).drop("_first")
    ids = blocks.select(*M, "block_id")
    edges = (
        facts["cfg_edges"]
        .join(ids.withColumnRenamed("block_id", "from_block_id"), [*M, "from_block_id"], "left_semi")
        .join(ids.withColumnRenamed("block_id", "to_block_id"), [*M, "to_block_id"], "left_semi")
    )
    return blocks, edges.select(*M, F.col("from_block_id").alias("src"), F.col("to_block_id").alias("dst"), "edge_kind", *[
        c.alias(n) for n, c in C.edge_flags().items()])


def block_nodes(facts: Facts) -> DataFrame:
    """(M, block_id, node_id); a node listed in two blocks of a method stays in the last one."""
    rows = facts["cfg_blocks"].select(*M, "block_id", "block_no", F.explode("node_ids").alias("node_id"))
    return rows.groupBy(*M, "node_id").agg(F.max_by("block_id", "block_no").alias("block_id"))


def mark_blocks(facts: Facts) -> DataFrame:
    """Blocks with has_sink / has_source / has_sanitizer."""
    held = facts["cfg_blocks"].select(*M, "block_id", F.explode("node_ids").alias("node_id"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = held.join(facts["nodes"].select(*KEYS, "node_id", "is_known_sink", "is_known_source", "is_known_sanitizer"), [*KEYS, "node_id"])
    flags = flags.groupBy(*M, "block_id").agg(
        any_("is_known_sink").alias("has_sink"), any_("is_known_source").alias("has_source"), any_("is_known_sanitizer").alias("has_sanitizer"))
    return facts["cfg_blocks"].join(flags, [*M, "block_id"], "left").na.fill(False, ["has_sink", "has_source", "has_sanitizer"])


def loop_blocks(facts: Facts) -> DataFrame:
    return cycle_nodes(clean_cfg(facts)[1], M).withColumnRenamed("node", "block_id")


def loop_nodes(facts: Facts) -> DataFrame:
    """(M, node): graph nodes inside a loop block."""
    held = facts["cfg_blocks"].select(*M, "block_id", F.explode("node_ids").alias("node_id"))
    return held.join(loop_blocks(facts), [*M, "block_id"], "left_semi").select(*M, node_id().alias("node")).distinct()


def mark_loop_nodes(nodes: DataFrame, facts: Facts) -> DataFrame:
    inside = loop_nodes(facts).withColumn("_in", F.lit(True))
    return nodes.join(inside, [*M, "node"], "left").withColumn("is_in_loop", F.coalesce("_in", F.lit(False))).drop("_in")


# --- enrichment of flow facts -------------------------------------------------------------


def alias_closure(facts: Facts) -> DataFrame:
    """(M, parameter_name, alias): locals set from a parameter, or from an alias of one."""
    steps = facts["assignments"].withColumnRenamed("containing_method_id", "method_id").select(
        *M, F.trim("source_text").alias("src"), F.trim("target_name").alias("dst"))
    seeds = facts["parameters"].select(*M, F.col("name").alias("parameter_name"), F.col("name").alias("node"))
    return closure(steps, seeds, M).where("depth > 0").select(*M, "parameter_name", F.col("node").alias("alias"))


def enrich_param_flows(facts: Facts) -> DataFrame:
    """(M, parameter_name, node_id): nodes with an argument that is the parameter or an alias of it."""
    names = facts["parameters"].select(*M, F.col("name").alias("parameter_name"), F.col("name").alias("text")).unionByName(
        alias_closure(facts).withColumnRenamed("alias", "text"))
    args = arguments(method_nodes(facts)).select(*M, "node_id", F.trim("text").alias("text"))
    return args.join(names, [*M, "text"]).select(*M, "parameter_name", "node_id").distinct()


def enrich_return_flows(facts: Facts) -> DataFrame:
    """Return flows with may_return_tainted set when a returned node has an argument that may be tainted."""
    hot = facts["nodes"].where(C.has_tainted_args()).select(*KEYS, "node_id")
    risky = facts["return_flows"].select(*M, F.explode("returned_node_ids").alias("node_id")).join(
        hot, [*KEYS, "node_id"], "left_semi").select(*M).distinct().withColumn("_hot", F.lit(True))
    return facts["return_flows"].join(risky, M, "left").withColumn(
        "may_return_tainted", F.col("may_return_tainted") | F.coalesce("_hot", F.lit(False))).drop("_hot")


def taint_candidates(nodes: DataFrame) -> DataFrame:
    """(M, node_id, role): sources and sinks of the methods that have both. Every source of a method
    pairs with every sink of it; the pairs are left implied, so a hot method stays linear."""
    per = nodes.groupBy(*M).agg(F.bool_or("is_known_source").alias("_s"), F.bool_or("is_known_sink").alias("_k"))
    return nodes.join(per.where("_s and _k"), M, "left_semi").select(
        *M, "node_id", F.explode(F.array_compact(F.array(
            F.when(F.col("is_known_source"), "source"), F.when(F.col("is_known_sink"), "sink")))).alias("role"))


def candidate_counts(nodes: DataFrame) -> DataFrame:
    """Per method with both roles: sources, sinks and implied pairs."""
    per = nodes.groupBy(*M).agg(F.count_if("is_known_source").alias("n_sources"), F.count_if("is_known_sink").alias("n_sinks"))
    return per.withColumn("n_pairs", F.col("n_sources") * F.col("n_sinks")).where("n_pairs > 0")
