"""Queries over derived code facts: columns, joins, graph construction, patterns, frameworks."""

from __future__ import annotations

from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.operators import build as B
from taintgrid.operators import frameworks as W
from taintgrid.operators import patterns as P
from taintgrid.operators import prefix as X
from taintgrid.operators.calls import call_edges, resolve_calls
from taintgrid.operators.lines import between_lines, near_lines
from taintgrid.plans import views as V
from taintgrid.plans.cases import case
from taintgrid.plans.views import _values, fact_ctes, facts
from taintgrid.session import KEYS
from taintgrid.sources.catalog import (
    ROLE_SANITIZERS, ROLE_SINKS, ROLE_SOURCES, SINK_KINDS, catalog_rows, load_roles, load_rules, load_sink_kinds,
)
from taintgrid.sources.facts import assign_batches, kept_source, merge_meta, package_refs

M = B.M
MK = "project_id, scan_id, method_id"
# argument tests in flat form
HOT0 = "(nargs > 0 AND NOT a0_lit AND a0_origin IN ('parameter', 'return_value', 'unknown'))"
HOT1 = "(nargs > 1 AND NOT a1_lit)"
FIRST_LIT = "(nargs > 0 AND a0_lit)"
ARGS = f"""args AS (
  SELECT {MK}, node_id, line, is_sink, is_source, is_san, {FIRST_LIT} AS first_lit, 0 AS position, a0_text AS text, a0_lit AS lit,
    a0_origin AS origin, a0_param AS param, a0_node AS onode FROM f_role WHERE nargs > 0
  UNION ALL SELECT {MK}, node_id, line, is_sink, is_source, is_san, {FIRST_LIT}, 1, 'p1', a1_lit, 'parameter', 'p1', NULL FROM f_role WHERE nargs > 1)"""
LIVE = "live AS (SELECT * FROM f_assign WHERE NOT is_literal)"
LAST = f"""lasta AS (SELECT {MK}, target_name, arg_max(assignment_id, ordinal) AS assignment_id, arg_max(line, ordinal) AS asgn_line
  FROM live GROUP BY {MK}, target_name)"""
CTRL = "(attrs LIKE '%ApiControllerAttribute%' OR name LIKE '%Controller' OR coalesce(base_class LIKE '%ControllerBase%', false))"


def same(a: str, b: str, cols: str = MK) -> str:
    return " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in cols.split(","))


# --- columns ----------------------------------------------------------------------------


@case("prj_tainted_arguments", fact_ctes() + f"""
SELECT node_id, {HOT0} OR {HOT1} AS has_tainted, CAST({HOT0} AS INT) + CAST({HOT1} AS INT) AS n_tainted,
  CASE WHEN {HOT0} THEN 0 WHEN {HOT1} THEN 1 END AS first_position,
  CASE WHEN is_sink AND ({HOT0} OR {HOT1}) THEN 1 WHEN is_sink OR is_source THEN 2 ELSE 3 END AS priority FROM f_role""")
def prj_tainted_arguments(spark, d):
    return facts(spark, d)["nodes"].select(
        "node_id", C.has_tainted_args().alias("has_tainted"), F.size(C.tainted_args()).alias("n_tainted"),
        C.tainted_position().alias("first_position"), C.analysis_priority().alias("priority"))


@case("prj_method_class_flags", fact_ctes() + f"""
SELECT m.method_id, attrs LIKE '%Http%' OR attrs LIKE '%Route%' AS is_action, attrs LIKE '%AllowAnonymous%' AS anonymous,
  c.controller, p.n_bound, p.n_user FROM f_methods m
JOIN (SELECT project_id, class_id, {CTRL} AS controller FROM f_classes) c ON c.project_id = m.project_id AND c.class_id = m.class_id
JOIN (SELECT project_id, method_id, count(*) FILTER (bindings LIKE 'From%') AS n_bound,
  count(*) FILTER (bindings LIKE 'From%' OR bindings = '') AS n_user FROM f_params GROUP BY 1, 2) p
  ON p.project_id = m.project_id AND p.method_id = m.method_id""")
def prj_method_class_flags(spark, d):
    f = facts(spark, d)
    flags = C.method_flags()
    cls = f["classes"].select(*KEYS, F.col("class_id").alias("containing_class_id"), C.class_flags()["is_controller"].alias("controller"))
    par = f["parameters"].groupBy(*M).agg(F.count_if(C.is_http_bound()).alias("n_bound"), F.count_if(C.is_user_controlled()).alias("n_user"))
    return f["methods"].join(cls, [*KEYS, "containing_class_id"]).join(par, M).select(
        "method_id", flags["is_action_method"].alias("is_action"), flags["allows_anonymous"].alias("anonymous"), "controller", "n_bound", "n_user")


@case("prj_symbols", fact_ctes() + "SELECT full_symbol AS symbol, count(*) AS n FROM f_nodes GROUP BY 1")
def prj_symbols(spark, d):
    nodes = facts(spark, d, roles=False)["nodes"]
    return nodes.groupBy(F.col("resolved_symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@case("prj_string_builds", fact_ctes() + """
SELECT assignment_id, CASE WHEN starts_with(target_name, '__interpolated') OR starts_with(target_name, '__string_concat') THEN 'STRING_BUILD'
  WHEN starts_with(target_name, '__collection') THEN 'COLLECTION' ELSE 'ASSIGNMENT' END AS kind,
  len(list_filter(regexp_extract_all(regexp_replace(source_text, '"(?:[^"\\\\]|\\\\.)*"', 'LITERAL', 'g'), '\\b[a-zA-Z_][a-zA-Z0-9_]*\\b'),
    lambda x: x NOT IN ('LITERAL','var','string','int','bool','new','return','null','true','false','using','this','if','else','ToString','String'))) > 0 AS has_variable,
  starts_with(source_text, '$"') OR (regexp_matches(source_text, '"[^"]*"') AND contains(source_text, '+')) AS is_concat FROM f_assign""")
def prj_string_builds(spark, d):
    return facts(spark, d)["assignments"].select(
        "assignment_id", C.dfg_node_kind().alias("kind"), C.string_build_has_variable("source_text").alias("has_variable"),
        C.is_string_concat("source_text").alias("is_concat"))


@case("prj_sink_arguments", fact_ctes(ARGS) + """
SELECT node_id, nargs = 0 OR a0_lit OR a0_origin = 'literal' OR starts_with(trim(a0_text), '"') AS literal_sink,
  CASE WHEN nargs > 0 AND contains(a0_text, '.') THEN split_part(a0_text, '.', 1) END AS base,
  CASE WHEN nargs = 0 OR a0_lit THEN false ELSE contains(a0_text, 'v1') END AS takes_v1 FROM f_role WHERE is_sink""")
def prj_sink_arguments(spark, d):
    nodes = facts(spark, d)["nodes"].where("is_known_sink")
    first = F.get(F.col("arguments"), F.lit(0))["text"]
    return nodes.select(
        "node_id", C.sink_is_literal().alias("literal_sink"), C.field_base(first).alias("base"), C.build_flows_to_sink(F.lit("v1")).alias("takes_v1"))


@case("prj_node_kinds", fact_ctes() + """
SELECT CASE WHEN is_sink THEN 'KNOWN_SINK' WHEN is_source THEN 'KNOWN_SOURCE' WHEN is_san THEN 'KNOWN_SANITIZER'
  WHEN kind = 'InvocationExpression' THEN CASE WHEN is_async_call THEN 'AWAIT_EXPR' WHEN full_symbol LIKE '%Linq%' THEN 'LINQ_EXPRESSION' ELSE 'METHOD_CALL' END
  WHEN kind = 'ObjectCreationExpression' THEN 'OBJECT_CREATION' WHEN kind = 'ReturnStatement' THEN 'RETURN_VALUE' ELSE 'METHOD_CALL' END AS kind,
  count(*) AS n FROM f_role GROUP BY 1""")
def prj_node_kinds(spark, d):
    return facts(spark, d)["nodes"].select(C.graph_node_kind().alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@case("prj_paths", """
SELECT page_id, regexp_replace(replace(url, chr(92), '/'), '^.*/', '') AS base, substr(url, 1, 20) AS head FROM pages""")
def prj_paths(spark, d):
    return V.table(spark, d, "pages").select("page_id", C.basename("url").alias("base"), C.short("url", 20).alias("head"))


@case("src_batches", "SELECT CAST((row_number() OVER (ORDER BY doc_id) - 1) // 250 AS BIGINT) AS batch_no, doc_id FROM documents WHERE source <> 'bin'")
def src_batches(spark, d):
    docs = V.table(spark, d, "documents").where(kept_source(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))))
    return assign_batches(docs.select("doc_id"), 250, order="doc_id").select("batch_no", "doc_id")


@case("src_merge_meta", """
SELECT 'p' || CAST(c_custkey % 7 AS STRING) AS project_id, count(*) AS n_files,
  max(CASE c_custkey % 7 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END) AS n_nuget_references, 'Latest' AS language_version FROM customer GROUP BY 1""")
def src_merge_meta(spark, d):
    return merge_meta(facts(spark, d)["meta"]).select("project_id", "n_files", "n_nuget_references", "language_version")


@case("src_packages", _values([("p1", "Dapper/2.1", "2.1", "dapper"), ("p1", "Microsoft.AspNetCore.App/8.0", "8.0", "aspnetcore"),
      ("p2", "EntityFramework/6.4", "6.4", "ef6"), ("p2", "System.ServiceModel.Http/6.0", "6.0", "wcf"), ("p3", "Grpc.AspNetCore", None, "grpc")],
      "project_id, ref, version, framework")[1:-1] + " WHERE project_id IN (SELECT 'p' || CAST(c_custkey % 7 AS STRING) FROM customer)")
def src_packages(spark, d):
    refs = package_refs(facts(spark, d)["meta"])
    return X.prefix_first(refs, W._pairs(spark, W.PACKAGE_FRAMEWORKS), ["framework"], symbol="package", how="inner").select(
        "project_id", "ref", "version", "framework")


# --- joins ------------------------------------------------------------------------------


@case("join_node_method_class", fact_ctes() + """
SELECT c.name AS class_name, m.name AS method_name, count(*) AS n FROM f_nodes f JOIN f_methods m ON m.method_id = f.method_id
JOIN f_classes c ON c.project_id = m.project_id AND c.class_id = m.class_id GROUP BY 1, 2""")
def join_node_method_class(spark, d):
    f = facts(spark, d)
    named = B.method_nodes(f).join(B.methods_with_class(f).select(*M, F.col("name").alias("method_name"), "class_name"), M)
    return named.groupBy("class_name", "method_name").agg(F.count(F.lit(1)).alias("n"))


_SINKS_SQL = _values([(i, p, k) for i, (p, k) in enumerate(zip(SINK_KINDS[::2], SINK_KINDS[1::2]))], "ordinal, prefix, vk")
_CAT = catalog_rows()
_CAT_SINKS_SQL = _values([(r["ordinal"], r["symbol"], r["id"]) for r in _CAT if r["rule_type"] == "sink"], "ordinal, prefix, rid")
_SRC_LABELS: dict[str, list] = {}
for _r in _CAT:
    if _r["rule_type"] == "source":
        _SRC_LABELS.setdefault(_r["symbol"], [_r["ordinal"], None])[1] = _r["taint_label"]
_SRC_SQL = _values([(o, s, label) for s, (o, label) in _SRC_LABELS.items()], "ordinal, prefix, label")
_SYMS = "syms AS (SELECT full_symbol AS symbol, count(*) AS n FROM f_nodes GROUP BY 1)"


@case("join_prefix_first", fact_ctes(_SYMS) + f"""
SELECT symbol, n, (SELECT arg_min(vk, ordinal) FROM {_SINKS_SQL} r WHERE starts_with(symbol, prefix)) AS kind FROM syms""")
def join_prefix_first(spark, d):
    syms = facts(spark, d)["nodes"].groupBy(F.col("resolved_symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    rules = load_sink_kinds(spark).withColumnRenamed("symbol", "prefix")
    return X.prefix_first(syms, rules, ["vulnerability_kind"], "symbol", "prefix").select("symbol", "n", F.col("vulnerability_kind").alias("kind"))


@case("join_prefix_longest", fact_ctes(_SYMS) + f"""
SELECT symbol, n, (SELECT arg_min(rid, struct_pack(a := -length(prefix), b := ordinal)) FROM {_CAT_SINKS_SQL} r WHERE starts_with(symbol, prefix)) AS rule_id FROM syms""")
def join_prefix_longest(spark, d):
    syms = facts(spark, d)["nodes"].groupBy(F.col("resolved_symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    rules = load_rules(spark).where("rule_type = 'sink'").withColumnRenamed("symbol", "prefix")
    return X.prefix_longest(syms, rules, ["id"], "symbol", "prefix").select("symbol", "n", F.col("id").alias("rule_id"))


def _pattern_values() -> str:
    rows = []
    for i, line in enumerate(P.PATTERNS.strip().splitlines()):
        pid, sym, kind, pos, cwe, score = line.split()
        a = pos == "always"
        rows.append((1, i, sym, pid, kind, a, "0" in pos or a, "1" in pos, P.PATTERN_CONFIDENCE.get(pid, "high"), float(score)))
    for r in _CAT:
        if r["rule_type"] == "sink":
            rows.append((2, r["ordinal"], r["symbol"], r["id"], r["vulnerability"], r["always_vulnerable"], 0 in r["tainted_args"],
                         1 in r["tainted_args"], r["confidence_level"], r["cvss_base"]))
    return _values([tuple(str(v).lower() if isinstance(v, bool) else v for v in r) for r in rows], "tier, ordinal, prefix, pid, vk, alw, p0, p1, conf, score")


_MATCH = f"""pat AS (SELECT symbol, arg_min(struct_pack(pid := pid, vk := vk, alw := alw = 'true', p0 := p0 = 'true', p1 := p1 = 'true', conf := conf, score := score),
    CASE WHEN tier = 1 AND prefix = symbol THEN 0 ELSE tier END * 100000 + ordinal) AS b
  FROM syms JOIN {_pattern_values()} r ON starts_with(symbol, prefix) GROUP BY symbol)"""


@case("join_match_pattern", fact_ctes(_SYMS, _MATCH) + "SELECT p.symbol, b.pid AS pattern_id, n FROM pat p JOIN syms s ON s.symbol = p.symbol")
def join_match_pattern(spark, d):
    syms = facts(spark, d)["nodes"].groupBy("resolved_symbol").agg(F.count(F.lit(1)).alias("n"))
    hit = X.match_pattern(syms, P.load_patterns(spark), P.catalog_patterns(load_rules(spark)), P.PATTERN_COLUMNS)
    return hit.select(F.col("resolved_symbol").alias("symbol"), "pattern_id", "n")


@case("join_roles", fact_ctes() + "SELECT full_symbol AS symbol, is_sink, is_source, is_san, count(*) AS n FROM f_role GROUP BY ALL")
def join_roles(spark, d):
    nodes = X.with_roles(facts(spark, d, roles=False)["nodes"], load_roles(spark))
    return nodes.groupBy(
        F.col("resolved_symbol").alias("symbol"), F.col("is_known_sink").alias("is_sink"), F.col("is_known_source").alias("is_source"),
        F.col("is_known_sanitizer").alias("is_san")).agg(F.count(F.lit(1)).alias("n"))


@case("join_sink_hierarchy", """
WITH RECURSIVE par AS (SELECT 'T' || CAST(p_partkey AS STRING) AS child, 'T' || CAST(p_partkey // 3 AS STRING) AS parent FROM part WHERE p_partkey > 0
  UNION SELECT 'T' || CAST(p_partkey AS STRING), 'I' || CAST(p_size AS STRING) FROM part),
use AS (SELECT 'T' || CAST(l_partkey AS STRING) AS t, 'M' || CAST(l_suppkey % 10 AS STRING) AS m, l_orderkey FROM lineitem),
up AS (SELECT DISTINCT t AS seed, t AS node FROM use UNION SELECT up.seed, par.parent FROM up JOIN par ON par.child = up.node)
SELECT t AS resolved_type, m AS method_name, count(*) AS n FROM use WHERE EXISTS (SELECT 1 FROM up WHERE seed = t AND
  (starts_with(node, 'T17') OR starts_with(node || '.' || m, 'T17') OR starts_with(node, 'I4') OR starts_with(node || '.' || m, 'I4') OR starts_with(node || '.' || m, 'T5.M3'))) GROUP BY 1, 2""")
def join_sink_hierarchy(spark, d):
    part, li = V.table(spark, d, "part"), V.table(spark, d, "lineitem")
    t = lambda c: F.concat(F.lit("T"), c.cast("string"))
    parents = part.where("p_partkey > 0").select(t(F.col("p_partkey")).alias("child"), t(F.floor(F.col("p_partkey") / 3)).alias("parent")).union(
        part.select(t(F.col("p_partkey")), F.concat(F.lit("I"), F.col("p_size").cast("string"))))
    nodes = li.select(t(F.col("l_partkey")).alias("resolved_type"), F.concat(F.lit("M"), (F.col("l_suppkey") % 10).cast("string")).alias("method_name"), "l_orderkey")
    rules = spark.createDataFrame([("sink", "T17"), ("sink", "I4"), ("sink", "T5.M3")], "rule_type string, symbol string")
    return X.sink_by_hierarchy(nodes, parents, rules).groupBy("resolved_type", "method_name").agg(F.count(F.lit(1)).alias("n"))


_CALLS_SQL = f"""csym AS (SELECT DISTINCT project_id, scan_id, full_symbol AS symbol FROM f_nodes WHERE kind = 'InvocationExpression'),
called AS (SELECT s.project_id, s.scan_id, s.symbol, arg_min(m.method_id, m.ordinal) AS callee FROM csym s JOIN f_methods m
  ON m.project_id = s.project_id AND (lower(s.symbol) = lower(m.name) OR ends_with(lower(s.symbol), '.' || lower(m.name))
    OR contains(lower(s.symbol), '.' || lower(m.name) || '(') OR ends_with(lower(s.symbol), lower(m.name) || 'async')) GROUP BY ALL)"""


@case("join_calls", fact_ctes(_CALLS_SQL) + """
SELECT n.method_id, c.callee, count(*) AS n FROM f_nodes n JOIN called c ON c.project_id = n.project_id AND c.symbol = n.full_symbol
WHERE n.kind = 'InvocationExpression' GROUP BY 1, 2""")
def join_calls(spark, d):
    f = facts(spark, d)
    return call_edges(f["nodes"], f["methods"]).groupBy("method_id", F.col("callee_method_id").alias("callee")).agg(F.count(F.lit(1)).alias("n"))


@case("join_calls_suffix", fact_ctes("named AS (SELECT m.*, c.name AS class_name FROM f_methods m JOIN f_classes c ON c.project_id = m.project_id AND c.class_id = m.class_id)") + """
SELECT s.project_id, s.symbol, arg_min(m.method_id, m.ordinal) AS callee FROM (SELECT DISTINCT project_id, full_symbol AS symbol FROM f_nodes) s
JOIN named m ON m.project_id = s.project_id AND ends_with(s.symbol, m.class_name || '.' || m.name) GROUP BY 1, 2""")
def join_calls_suffix(spark, d):
    f = facts(spark, d)
    called = resolve_calls(f["nodes"], B.methods_with_class(f), "suffix")
    return called.select("project_id", F.col("resolved_symbol").alias("symbol"), F.col("callee_method_id").alias("callee"))


@case("join_near_lines", fact_ctes() + f"""
SELECT a.node_id AS source, b.node_id AS sink FROM f_role a JOIN f_role b ON {same('a', 'b')} WHERE a.is_source AND b.is_sink AND abs(a.line - b.line) <= 5""")
def join_near_lines(spark, d):
    n = B.method_nodes(facts(spark, d))
    a = n.where("is_known_source").select(*M, F.col("node_id").alias("source"), F.col("line").alias("line_a"))
    b = n.where("is_known_sink").select(*M, F.col("node_id").alias("sink"), F.col("line").alias("line_b"))
    return near_lines(a, b, 5, M).select("source", "sink")


@case("join_between_lines", fact_ctes() + f"""
SELECT a.assignment_id, b.node_id, EXISTS (SELECT 1 FROM f_role s WHERE {same('s', 'b')} AND s.is_san AND s.line BETWEEN a.line AND b.line) AS guarded
FROM f_assign a JOIN f_role b ON {same('a', 'b')} WHERE b.is_sink AND abs(a.line - b.line) <= 10""")
def join_between_lines(spark, d):
    f = facts(spark, d)
    n = B.method_nodes(f)
    a = f["assignments"].select(*KEYS, F.col("containing_method_id").alias("method_id"), "assignment_id", F.col("line").alias("line_a"))
    pairs = near_lines(a, n.where("is_known_sink").select(*M, "node_id", F.col("line").alias("line_b")), 10, M)
    ids = [*M, "assignment_id", "node_id"]
    yes = between_lines(pairs, n.where("is_known_sanitizer"), M, ids, "line_a", "line_b")
    no = between_lines(pairs, n.where("is_known_sanitizer"), M, ids, "line_a", "line_b", anti=True)
    return yes.select("assignment_id", "node_id", F.lit(True).alias("guarded")).union(no.select("assignment_id", "node_id", F.lit(False)))


@case("join_candidates", fact_ctes() + f"""
SELECT method_id, count(*) FILTER (is_source) AS n_sources, count(*) FILTER (is_sink) AS n_sinks, count(*) FILTER (is_source) * count(*) FILTER (is_sink) AS n_pairs
FROM f_role GROUP BY {MK} HAVING count(*) FILTER (is_source) * count(*) FILTER (is_sink) > 0""")
def join_candidates(spark, d):
    return B.candidate_counts(B.method_nodes(facts(spark, d))).select("method_id", "n_sources", "n_sinks", "n_pairs")


# --- graph construction -----------------------------------------------------------------

_BLD = {
    "param_use": """SELECT 'p:' || u.method_id || ':' || parameter_name AS src, 'n:' || u.node_id AS dst FROM f_used u""",
    "node_to_assignment": "SELECT 'n:' || source_node_id AS src, 'a:' || assignment_id AS dst FROM live WHERE source_node_id IS NOT NULL",
    "param_alias": f"""SELECT 'p:' || u.method_id || ':' || parameter_name AS src, 'a:' || a.assignment_id AS dst FROM f_assigned u
        JOIN live a ON {same('u', 'a')} AND a.source_node_id = u.node_id""",
    "local_use": f"""SELECT 'a:' || l.assignment_id AS src, 'n:' || a.node_id AS dst FROM args a JOIN lasta l ON {same('a', 'l')} AND l.target_name = a.text WHERE a.origin = 'local_variable'""",
    "string_build": f"""SELECT 'a:' || a.assignment_id AS src, 'n:' || s.node_id AS dst FROM live a JOIN f_role s ON {same('a', 's')} AND s.is_sink AND abs(s.line - a.line) <= 2
        WHERE a.target_name IN ('__interpolated_string', '__string_concat') AND NOT (s.nargs > 0 AND s.a0_lit)""",
    "param_arg": f"""SELECT 'p:' || a.method_id || ':' || a.param AS src, 'n:' || a.node_id AS dst FROM args a JOIN f_params p ON {same('a', 'p')} AND p.name = a.param
        WHERE NOT a.lit AND a.origin = 'parameter'""",
    "param_field": f"""SELECT 'p:' || a.method_id || ':' || p.name AS src, 'n:' || a.node_id AS dst FROM args a JOIN f_params p ON {same('a', 'p')} AND p.name = split_part(a.text, '.', 1)
        WHERE NOT a.lit AND a.origin = 'field' AND contains(a.text, '.')""",
    "return_value": "SELECT 'n:' || a.onode AS src, 'n:' || a.node_id AS dst FROM args a WHERE NOT a.lit AND a.origin = 'return_value' AND a.onode IS NOT NULL",
    "source_text": f"""SELECT DISTINCT 'n:' || s.node_id AS src, 'a:' || a.assignment_id AS dst FROM f_role s JOIN live a ON {same('s', 'a')}
        WHERE s.is_source AND (a.line = s.line OR contains(a.source_text, s.text))""",
    "variable_to_sink": f"""SELECT DISTINCT 'a:' || l.assignment_id AS src, 'n:' || a.node_id AS dst FROM args a JOIN lasta l ON {same('a', 'l')} AND l.target_name = a.text
        WHERE a.is_sink AND NOT a.lit AND NOT a.first_lit AND NOT EXISTS (SELECT 1 FROM args z WHERE {same('z', 'a')} AND z.is_san AND NOT z.lit
          AND z.text = a.text AND z.line BETWEEN l.asgn_line AND a.line)""",
}
DFG_CTES = (ARGS, LIVE, LAST)
DFG_SQL = "dfg AS (" + " UNION ".join(f"SELECT src, dst FROM ({q}) AS q_{n}" for n, q in _BLD.items()) + ")"


def _edge_case(name: str, rule):
    @case(f"bld_{name}", fact_ctes(*DFG_CTES) + _BLD[name])
    def run(spark, d):
        return rule(facts(spark, d)).select("src", "dst")


for _name, _rule in B.RULES.items():
    _edge_case(_name, _rule)


@case("bld_dfg", fact_ctes(*DFG_CTES, DFG_SQL) + "SELECT src, dst FROM dfg")
def bld_dfg(spark, d):
    return B.build_dfg(B.written(facts(spark, d))).select("src", "dst")


@case("bld_interprocedural", fact_ctes("""named AS (SELECT m.*, c.name AS class_name FROM f_methods m JOIN f_classes c ON c.project_id = m.project_id AND c.class_id = m.class_id)""",
      "pick AS (SELECT n.project_id, n.full_symbol, arg_min(m.method_id, m.ordinal) AS callee FROM (SELECT DISTINCT project_id, full_symbol FROM f_nodes) n JOIN named m ON m.project_id = n.project_id AND ends_with(n.full_symbol, m.class_name || '.' || m.name) GROUP BY 1, 2)") + """
SELECT 'r:' || p.callee AS src, 'c:' || n.node_id AS dst FROM f_nodes n JOIN pick p ON p.project_id = n.project_id AND p.full_symbol = n.full_symbol
WHERE EXISTS (SELECT 1 FROM f_returns r WHERE r.project_id = n.project_id AND r.method_id = p.callee AND r.may_return_tainted)""")
def bld_interprocedural(spark, d):
    return B.edges_interprocedural(facts(spark, d)).select("src", "dst")


@case("bld_returned_by", fact_ctes() + """
SELECT DISTINCT 'n:' || r.node_id AS src, 'n:' || n.node_id AS dst FROM f_nodes n JOIN f_methods m ON m.project_id = n.project_id AND contains(n.full_symbol, m.name)
JOIN f_returns r ON r.project_id = m.project_id AND r.method_id = m.method_id WHERE n.kind = 'InvocationExpression'""")
def bld_returned_by(spark, d):
    return B.edges_returned_by(facts(spark, d)).select("src", "dst")


@case("bld_unified_nodes", fact_ctes(LIVE) + """
SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN is_sink THEN 'KNOWN_SINK' WHEN is_source THEN 'KNOWN_SOURCE' WHEN is_san THEN 'KNOWN_SANITIZER'
    WHEN kind = 'InvocationExpression' THEN CASE WHEN is_async_call THEN 'AWAIT_EXPR' WHEN full_symbol LIKE '%Linq%' THEN 'LINQ_EXPRESSION' ELSE 'METHOD_CALL' END
    WHEN kind = 'ObjectCreationExpression' THEN 'OBJECT_CREATION' WHEN kind = 'ReturnStatement' THEN 'RETURN_VALUE' ELSE 'METHOD_CALL' END AS kind FROM f_role
  UNION ALL SELECT 'PARAMETER' FROM f_params
  UNION ALL SELECT CASE WHEN contains(target_name, 'interpolated') THEN 'STRING_INTERPOLATION' WHEN contains(target_name, 'concat') THEN 'STRING_CONCAT'
    WHEN contains(target_name, 'collection') THEN 'COLLECTION_ITEM' ELSE 'ASSIGNMENT' END FROM live) GROUP BY 1""")
def bld_unified_nodes(spark, d):
    nodes, _ = B.unified_graph(facts(spark, d))
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@case("bld_block_marks", fact_ctes() + "SELECT method_id, CAST(pos AS INT) AS block_id, is_sink AS has_sink, is_source AS has_source, is_san AS has_sanitizer FROM f_role")
def bld_block_marks(spark, d):
    return B.mark_blocks(facts(spark, d)).select("method_id", "block_id", "has_sink", "has_source", "has_sanitizer")


@case("bld_clean_cfg", fact_ctes() + "SELECT method_id, src, dst, edge_kind, edge_kind = 'true_branch' AS is_conditional, edge_kind = 'exception' AS is_exception FROM f_edges")
def bld_clean_cfg(spark, d):
    return B.clean_cfg(facts(spark, d))[1].select("method_id", "src", "dst", "edge_kind", "is_conditional", "is_exception")


_ALIAS = f"""al AS (SELECT {MK}, name AS parameter_name, name AS alias, 0 AS depth FROM f_params
  UNION SELECT al.project_id, al.scan_id, al.method_id, al.parameter_name, a.target_name, 1 FROM al JOIN f_assign a ON {same('al', 'a')} AND trim(a.source_text) = al.alias)"""


@case("bld_aliases", fact_ctes(_ALIAS) + f"SELECT DISTINCT {MK}, parameter_name, alias FROM al WHERE depth > 0")
def bld_aliases(spark, d):
    return B.alias_closure(facts(spark, d)).select(*M, "parameter_name", "alias")


@case("bld_param_flow_enrichment", fact_ctes(_ALIAS, ARGS) + f"""
SELECT DISTINCT a.method_id, al.parameter_name, a.node_id FROM args a JOIN al ON {same('a', 'al')} AND al.alias = trim(a.text)""")
def bld_param_flow_enrichment(spark, d):
    return B.enrich_param_flows(facts(spark, d)).select("method_id", "parameter_name", "node_id")


@case("bld_return_flow_taint", fact_ctes() + f"""
SELECT r.method_id, r.node_id, r.may_return_tainted OR EXISTS (SELECT 1 FROM f_returns q JOIN f_nodes n ON n.node_id = q.node_id
  WHERE q.method_id = r.method_id AND ({HOT0} OR {HOT1})) AS may_return_tainted FROM f_returns r""")
def bld_return_flow_taint(spark, d):
    return B.enrich_return_flows(facts(spark, d)).select("method_id", F.col("returned_node_ids")[0].alias("node_id"), "may_return_tainted")


# --- patterns ---------------------------------------------------------------------------

_GUARDS = f"""cmdg AS (SELECT {MK} FROM f_nodes GROUP BY {MK} HAVING bool_or(contains(lower(text), 'useshellexecute') AND contains(lower(text), 'false'))
    AND bool_or(contains(lower(text), 'argumentlist') OR contains(lower(full_symbol), 'argumentlist'))),
pathg AS (SELECT {MK} FROM (SELECT {MK}, bool_or(contains(lower(text), 'getfilename')) AS fname, bool_or(contains(lower(text), 'getfullpath')) AS ffull,
    bool_or(contains(lower(text), 'startswith')) AS fstart FROM f_nodes GROUP BY {MK}) q WHERE (fname AND (ffull OR fstart)) OR (ffull AND fstart)),
hostg AS (SELECT {MK} FROM f_nodes GROUP BY {MK} HAVING bool_or(contains(lower(text), '.host') AND (contains(lower(text), 'contains(') OR contains(lower(text), 'indexof(')))
    AND bool_or(contains(lower(text), 'allowedhost')))"""


@case("pat_guards", fact_ctes(_GUARDS) + "SELECT 'command' AS guard, method_id FROM cmdg UNION ALL SELECT 'path', method_id FROM pathg UNION ALL SELECT 'host', method_id FROM hostg")
def pat_guards(spark, d):
    n = B.method_nodes(facts(spark, d))
    one = lambda g, df: df.select(F.lit(g).alias("guard"), "method_id")
    return one("command", P.command_guard(n)).union(one("path", P.path_guard(n))).union(one("host", P.host_guard(n)))


_HITS = f"""hits AS (SELECT r.*, b.pid, b.vk, b.alw, b.score, CASE WHEN is_in_try AND b.conf = 'confirmed' THEN 'high'
    WHEN ({HOT0} OR {HOT1}) AND b.conf = 'high' THEN 'confirmed' ELSE b.conf END AS confidence FROM f_role r JOIN pat p ON p.symbol = r.full_symbol
  WHERE b.alw OR (((b.p0 AND nargs > 0 AND NOT a0_lit) OR (b.p1 AND nargs > 1 AND NOT a1_lit))
    AND NOT (b.vk = 'COMMAND_INJECTION' AND EXISTS (SELECT 1 FROM cmdg g WHERE {same('g', 'r')}))
    AND NOT (b.vk = 'PATH_TRAVERSAL' AND EXISTS (SELECT 1 FROM pathg g WHERE {same('g', 'r')}))
    AND NOT (b.vk = 'SSRF' AND EXISTS (SELECT 1 FROM hostg g WHERE {same('g', 'r')}))))"""


@case("pat_findings", fact_ctes(_SYMS, _MATCH, _GUARDS, _HITS) + "SELECT node_id, pid AS pattern_id, vk AS vulnerability_kind, confidence, score AS cvss_base FROM hits")
def pat_findings(spark, d):
    out = P.match_patterns(facts(spark, d), P.load_patterns(spark), load_rules(spark))
    return out.select("node_id", "pattern_id", "vulnerability_kind", "confidence", "cvss_base")


@case("pat_attributes", fact_ctes() + """
SELECT target_id, CASE attribute_name WHEN 'AllowHtmlAttribute' THEN 'ATTR-002' ELSE 'ATTR-001' END AS pattern_id,
  CASE attribute_name WHEN 'AllowHtmlAttribute' THEN 'low' ELSE 'medium' END AS confidence FROM f_notes WHERE attribute_name IN ('AllowHtmlAttribute', 'ValidateInputAttribute')""")
def pat_attributes(spark, d):
    return P.match_attributes(facts(spark, d)).select("target_id", "pattern_id", "confidence")


# --- framework rules ----------------------------------------------------------------------

_NAMED = "named AS (SELECT m.*, c.name AS class_name, " + CTRL.replace("attrs", "c.attrs").replace("name LIKE", "c.name LIKE").replace("base_class", "c.base_class") + \
    " AS controller, c.attrs AS cattrs FROM f_methods m JOIN f_classes c ON c.project_id = m.project_id AND c.class_id = m.class_id)"
_FWK = {
    "deprecated": "SELECT node_id AS target_id, 'FW-DEPR-001' AS rule_id FROM f_nodes WHERE starts_with(full_symbol, 'System.Runtime.Serialization.Formatters.Binary.BinaryFormatter')",
    "weak_crypto": "SELECT node_id AS target_id, 'FW-CRYPTO-001' AS rule_id FROM f_nodes WHERE starts_with(full_symbol, 'System.Security.Cryptography.MD5')",
    "secrets": "SELECT assignment_id AS target_id, 'FW-SECRET-001' AS rule_id FROM f_assign WHERE is_literal AND regexp_matches(lower(target_name), 'token|secret|password') AND length(source_text) >= 6 AND length(trim(source_text, '\"''')) >= 4",
    "insecure_random": "SELECT n.node_id AS target_id, 'FW-CRYPTO-006' AS rule_id FROM f_nodes n JOIN f_methods m ON m.method_id = n.method_id WHERE starts_with(n.full_symbol, 'System.Random') AND (regexp_matches(lower(m.name), 'token|nonce|salt|key|password|session|csrf|otp|captcha|secret') OR regexp_matches(lower(n.text), 'token|nonce|salt|key|password|session|csrf|otp|captcha|secret'))",
    "csrf": """SELECT method_id AS target_id, 'FW-ASPNET-001' AS rule_id FROM named m WHERE controller AND (attrs LIKE '%HttpPost%' OR attrs LIKE '%HttpPut%')
        AND attrs NOT LIKE '%ValidateAntiForgery%' AND cattrs NOT LIKE '%ApiController%'""",
    "anonymous_route": """SELECT method_id AS target_id, 'FW-ASPNET-002' AS rule_id FROM named WHERE controller AND is_entry_point AND attrs LIKE '%AllowAnonymous%' AND cattrs LIKE '%Authorize%' AND o_custkey % 3 = 0""",
    "model_validation": """SELECT m.method_id AS target_id, 'FW-ASPNET-003' AS rule_id FROM named m WHERE controller AND is_entry_point AND cattrs NOT LIKE '%ApiController%'
        AND EXISTS (SELECT 1 FROM f_params p WHERE p.method_id = m.method_id AND (p.bindings LIKE 'From%' OR p.bindings = ''))
        AND EXISTS (SELECT 1 FROM f_params p WHERE p.method_id = m.method_id AND contains(p.resolved_type, '.') AND NOT contains(p.resolved_type, 'System.') AND NOT contains(p.resolved_type, 'Microsoft.'))
        AND NOT EXISTS (SELECT 1 FROM f_nodes n WHERE n.method_id = m.method_id AND (contains(n.text, 'ModelState') OR contains(n.text, 'IsValid')))""",
    "cors": """SELECT arg_max(node_id, ordinal) AS target_id, 'FW-CORS-001' AS rule_id FROM f_nodes n WHERE contains(text, 'AllowAnyOrigin')
        AND EXISTS (SELECT 1 FROM f_nodes k WHERE k.project_id = n.project_id AND contains(k.text, 'AllowCredentials')) GROUP BY project_id""",
    "open_redirect": f"""SELECT node_id AS target_id, 'FW-ASPNET-004' AS rule_id FROM f_nodes n WHERE starts_with(full_symbol, 'Microsoft.AspNetCore.Mvc.ControllerBase.Redirect') AND nargs > 0 AND NOT a0_lit
        AND EXISTS (SELECT 1 FROM f_nodes k WHERE {same('k', 'n')} AND contains(lower(k.text), 'request.query'))""",
    "validate_input": "SELECT target_id, 'FW-MVC-001' AS rule_id FROM f_notes WHERE attribute_name = 'ValidateInputAttribute' AND contains(lower(args), 'false')",
    "raw_sql": f"SELECT node_id AS target_id, 'FW-EF-001' AS rule_id FROM f_nodes WHERE contains(full_symbol, 'RelationalQueryableExtensions.FromSqlRaw') AND ({HOT0} OR {HOT1}) AND contains(text, '+')",
    "binding": """SELECT node_id AS target_id, 'FW-WCF-001' AS rule_id FROM f_nodes a WHERE contains(full_symbol, 'System.ServiceModel.BasicHttpBinding')
        AND EXISTS (SELECT 1 FROM f_nodes b WHERE b.project_id = a.project_id AND b.file = a.file AND abs(a.line - b.line) <= 10 AND contains(b.text, 'Security.Mode') AND contains(b.text, 'None'))""",
}


def _rule_case(name: str, rule):
    @case(f"fwk_{name}", fact_ctes(_NAMED) + _FWK[name])
    def run(spark, d):
        return rule(facts(spark, d)).select("target_id", "rule_id")


for _name, _rule in W.RULE_FUNCTIONS.items():
    _rule_case(_name, _rule)

_DETECT = """pk AS (SELECT * FROM (VALUES ('p1', 'dapper', '2.1'), ('p1', 'aspnetcore', '8.0'), ('p2', 'ef6', '6.4'), ('p2', 'wcf', '6.0'), ('p3', 'grpc', NULL)) AS t(project_id, framework, version)),
ext AS (SELECT DISTINCT project_id, symbol FROM f_nodes WHERE k % 3 = 1),
ev AS (SELECT project_id, framework, 2 AS step, 'high' AS confidence, version FROM pk WHERE project_id IN (SELECT project_id FROM f_classes)
  UNION ALL SELECT project_id, 'aspnetcore', 3, 'medium', NULL FROM ext WHERE regexp_matches(symbol, '^Microsoft\\.AspNetCore\\.(Mvc|Http|Routing)')
  UNION ALL SELECT project_id, 'ef_core', 3, 'medium', NULL FROM ext WHERE starts_with(symbol, 'Microsoft.EntityFrameworkCore')
  UNION ALL SELECT project_id, 'wcf', 3, 'medium', NULL FROM ext WHERE starts_with(symbol, 'System.ServiceModel')
  UNION ALL SELECT project_id, 'aspnetcore', 4, 'high', NULL FROM f_classes WHERE attrs LIKE '%ApiController%' OR attrs LIKE '%Route%'
  UNION ALL SELECT project_id, 'aspnetcore', 5, 'high', NULL FROM f_classes WHERE base_class LIKE '%Microsoft.AspNetCore.Mvc.Controller%'
  UNION ALL SELECT project_id, 'aspnetcore', 6, 'high', NULL FROM f_methods WHERE attrs LIKE '%Http%'
  UNION ALL SELECT project_id, 'ef_core', 7, 'high', NULL FROM f_nodes WHERE contains(full_symbol, 'Microsoft.EntityFrameworkCore')),
det AS (SELECT project_id, framework, min(step) AS step, arg_min(confidence, step) AS confidence, CASE WHEN min(step) = 2 THEN max(version) END AS version FROM ev GROUP BY 1, 2),
prio AS (SELECT *, CASE framework WHEN 'aspnetcore' THEN 1 WHEN 'aspnet_mvc' THEN 2 WHEN 'wcf' THEN 3 WHEN 'winforms' THEN 4 WHEN 'grpc' THEN 5 WHEN 'signalr' THEN 6 WHEN 'ef_core' THEN 7 WHEN 'ef6' THEN 8 WHEN 'dapper' THEN 9 ELSE 50 END AS pr FROM det)"""


@case("fwk_detection", fact_ctes(_DETECT) + "SELECT project_id, framework, CAST(step AS INT) AS step, confidence, version FROM det")
def fwk_detection(spark, d):
    return W.detect_frameworks(facts(spark, d)).select("project_id", "framework", "step", "confidence", "version")


@case("fwk_primary", fact_ctes(_DETECT) + "SELECT project_id, arg_min(framework, pr) AS primary_framework FROM prio GROUP BY 1")
def fwk_primary(spark, d):
    return W.primary_framework(W.detect_frameworks(facts(spark, d))).select("project_id", "primary_framework")


@case("fwk_profile_flags", fact_ctes() + """
SELECT project_id, bool_or(is_async AND is_entry_point) AS has_async_endpoints, true AS uses_model_binding, false AS has_minimal_api, false AS has_razor_pages,
  true AS has_nullable_annotations FROM f_methods GROUP BY 1""")
def fwk_profile_flags(spark, d):
    return W.profile_flags(facts(spark, d)).select(
        "project_id", "has_async_endpoints", "uses_model_binding", "has_minimal_api", "has_razor_pages", "has_nullable_annotations")


_SETS = _values([(fw, k, s) for k, table in (("source", W.SOURCE_SETS), ("sink", W.SINK_SETS)) for fw, sets in table.items() for s in sets], "framework, set_kind, rule_set")
_ALWAYS = _values(W.ALWAYS_SETS, "set_kind, rule_set")


@case("fwk_rule_sets", fact_ctes(_DETECT) + f"""
SELECT DISTINCT project_id, set_kind, rule_set FROM det JOIN {_SETS} s ON s.framework = det.framework
UNION SELECT DISTINCT project_id, set_kind, rule_set FROM det CROSS JOIN {_ALWAYS} a""")
def fwk_rule_sets(spark, d):
    return W.active_rule_sets(W.detect_frameworks(facts(spark, d))).select("project_id", "set_kind", "rule_set")


_FSRC = _values(list(zip(W.FRAMEWORK_SOURCES[::3], W.FRAMEWORK_SOURCES[1::3], W.FRAMEWORK_SOURCES[2::3])), "framework, symbol, value")


@case("fwk_source_symbols", fact_ctes(_DETECT) + f"""
SELECT DISTINCT project_id, symbol, value FROM det JOIN {_FSRC} s ON s.framework = det.framework OR s.framework = '*'""")
def fwk_source_symbols(spark, d):
    return W.framework_symbols(W.detect_frameworks(facts(spark, d))).select("project_id", "symbol", "value")


_GATED = " UNION ALL ".join(f"SELECT target_id, rule_id FROM ({q}) AS w_{n}" for n, q in _FWK.items())
_GATE = _values([(r, fw) for r, fws in W.GATES.items() for fw in fws], "rule_id, framework")


@case("fwk_findings", fact_ctes(_NAMED, _DETECT, f"raw AS ({_GATED})", """owner AS (SELECT node_id AS target_id, project_id FROM f_nodes UNION ALL SELECT method_id, project_id FROM f_methods
  UNION ALL SELECT assignment_id, project_id FROM f_assign)""") + f"""
SELECT o.project_id, r.rule_id, count(*) AS n FROM raw r JOIN owner o ON o.target_id = r.target_id
WHERE r.rule_id NOT IN (SELECT rule_id FROM {_GATE} g) OR EXISTS (SELECT 1 FROM {_GATE} g JOIN det ON det.framework = g.framework AND det.project_id = o.project_id WHERE g.rule_id = r.rule_id)
GROUP BY 1, 2""")
def fwk_findings(spark, d):
    return W.framework_findings(B.written(facts(spark, d))).groupBy("project_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
