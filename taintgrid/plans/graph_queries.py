"""Queries over graphs: event walks, control flow of derived methods, and the supplier-part call graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from taintgrid.operators import build as B
from taintgrid.operators import graph as G
from taintgrid.operators import taint as T
from taintgrid.operators import weighted as W
from taintgrid.plans import views as V
from taintgrid.plans.cases import case
from taintgrid.plans.fact_queries import (
    _GUARDS, _SINKS_SQL, _SRC_SQL, ARGS, DFG_CTES, DFG_SQL, LIVE, MK, same,
)
from taintgrid.plans.views import fact_ctes, facts, step_ctes, steps
from taintgrid.session import KEYS, checkpoint
from taintgrid.sources.catalog import load_rules, load_sink_kinds
from taintgrid.sources.sinks import clean_graph

M = B.M
SM = ["method_id"]  # event walks have no project

# --- the supplier-part call graph -----------------------------------------------------------

CALL_SQL = """
SELECT DISTINCT 's' || CAST(l_suppkey AS STRING) AS src, 'q' || CAST(l_partkey AS STRING) AS dst FROM lineitem WHERE l_quantity <= 3
UNION SELECT DISTINCT 'q' || CAST(l_partkey AS STRING), 's' || CAST(l_suppkey AS STRING) FROM lineitem WHERE l_quantity > 48"""
SEED_SQL = "SELECT 's' || CAST(s_suppkey AS STRING) AS node FROM supplier WHERE s_suppkey % 10 = 0"


def call_graph(spark, d):
    return V.run_sql(spark, d, V._braced(CALL_SQL, V.TABLES)), V.run_sql(spark, d, V._braced(SEED_SQL, V.TABLES))


@case("grf_reach_calls", f"""WITH RECURSIVE e AS ({CALL_SQL}), r AS ({SEED_SQL} UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r""")
def grf_reach_calls(spark, d):
    edges, seeds = call_graph(spark, d)
    return G.reachable(edges, seeds, []).select("node")


@case("grf_reach_depth", step_ctes("r AS (SELECT method_id, node_id AS node, 0 AS depth FROM s_nodes WHERE is_source UNION SELECT r.method_id, e.dst, depth + 1 FROM r JOIN s_edges e ON e.method_id = r.method_id AND e.src = r.node WHERE depth < 3)") + """
SELECT method_id, node, min(depth) AS depth FROM r GROUP BY 1, 2""")
def grf_reach_depth(spark, d):
    nodes, edges = steps(spark, d)
    return G.reachable(edges, nodes.where("is_source").select("method_id", F.col("node_id").alias("node")), SM, max_depth=3)


@case("grf_neighbors", step_ctes() + """
SELECT 'out' AS side, e.src, e.dst, e.edge_kind FROM s_edges e JOIN s_nodes n ON n.node_id = e.src WHERE n.is_source
UNION ALL SELECT 'in', e.src, e.dst, e.edge_kind FROM s_edges e JOIN s_nodes n ON n.node_id = e.dst WHERE n.is_source""")
def grf_neighbors(spark, d):
    nodes, edges = steps(spark, d)
    ids = G.select_nodes(nodes, flags=["is_source"]).select("method_id", F.col("node_id").alias("node"))
    out = [G.neighbors(edges, ids, SM, s).select(F.lit(s).alias("side"), "src", "dst", "edge_kind") for s in ("out", "in")]
    return out[0].union(out[1])


@case("grf_induced", step_ctes() + """
SELECT e.src, e.dst, e.edge_kind FROM s_edges e JOIN s_nodes a ON a.node_id = e.src JOIN s_nodes b ON b.node_id = e.dst
WHERE a.kind IN ('signup', 'click', 'purchase') AND b.kind IN ('signup', 'click', 'purchase')""")
def grf_induced(spark, d):
    nodes, edges = steps(spark, d)
    kept = G.select_nodes(nodes, kinds=["signup", "click", "purchase"]).withColumnRenamed("node_id", "node")
    return G.induced_edges(edges, kept, SM).select("src", "dst", "edge_kind")


# every source with every sink of its walk
_PAIRS = """pairs AS (SELECT a.method_id, a.node_id AS source, b.node_id AS target FROM s_nodes a JOIN s_nodes b ON b.method_id = a.method_id WHERE a.is_source AND b.is_sink)"""
_E2 = "s_edges2 AS (SELECT DISTINCT method_id, src, dst FROM s_edges)"


def step_pairs(nodes):
    sources = nodes.where("is_source").select("method_id", F.col("node_id").alias("source"))
    return sources.join(nodes.where("is_sink").select("method_id", F.col("node_id").alias("target")), "method_id")


@case("grf_simple_paths", step_ctes(_E2, """walk AS (SELECT method_id, node_id AS source, node_id AS node, [node_id] AS path FROM s_nodes WHERE is_source
  UNION ALL SELECT w.method_id, w.source, e.dst, list_append(w.path, e.dst) FROM walk w JOIN s_edges2 e ON e.method_id = w.method_id AND e.src = w.node WHERE NOT list_contains(w.path, e.dst))""") + """
SELECT w.method_id, w.source, w.node AS target, row_number() OVER (PARTITION BY w.method_id, w.source, w.node ORDER BY len(path), path) AS path_no, len(path) - 1 AS hops, array_to_string(path, '>') AS path
FROM walk w JOIN s_nodes n ON n.method_id = w.method_id AND n.node_id = w.node WHERE n.is_sink AND len(path) > 1""")
def grf_simple_paths(spark, d):
    nodes, edges = steps(spark, d)
    out = G.simple_paths(edges, step_pairs(nodes), SM)
    place = Window.partitionBy("method_id", "source", "target").orderBy("hops", "path")
    return out.withColumn("path_no", F.row_number().over(place)).select(
        "method_id", "source", "target", "path_no", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@case("grf_shortest_paths", step_ctes(_E2, """bfs AS (SELECT method_id, node_id AS source, node_id AS node, [node_id] AS path FROM s_nodes WHERE is_source
  UNION ALL SELECT b.method_id, b.source, b.dst, min(b.np) FROM (SELECT b.method_id, b.source, e.dst, list_append(b.path, e.dst) AS np
    FROM bfs b JOIN s_edges2 e ON e.method_id = b.method_id AND e.src = b.node) b GROUP BY 1, 2, 3)""") + """
SELECT b.method_id, b.source, b.node AS target, min(len(path) - 1) AS hops, array_to_string(arg_min(path, struct_pack(n := len(path), p := path)), '>') AS path
FROM bfs b JOIN s_nodes n ON n.method_id = b.method_id AND n.node_id = b.node WHERE n.is_sink GROUP BY 1, 2, 3""")
def grf_shortest_paths(spark, d):
    nodes, edges = steps(spark, d)
    out = G.shortest_paths(edges, step_pairs(nodes), SM)
    return out.select("method_id", "source", "target", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


# --- control flow -----------------------------------------------------------------------

_CL = f"""ce AS (SELECT DISTINCT {MK}, src, dst FROM f_edges),
cl AS (SELECT {MK}, src AS a, dst AS b FROM ce UNION SELECT cl.project_id, cl.scan_id, cl.method_id, cl.a, e.dst FROM cl JOIN ce e ON {same('cl', 'e')} AND e.src = cl.b)"""


@case("grf_cycle_nodes", fact_ctes(_CL) + "SELECT method_id, a AS block_id FROM cl WHERE a = b")
def grf_cycle_nodes(spark, d):
    return B.loop_blocks(facts(spark, d)).select("method_id", "block_id")


@case("grf_components", fact_ctes(_CL) + """
SELECT x.method_id, x.a AS node, max(y.b) AS component FROM cl x JOIN cl y ON y.method_id = x.method_id AND y.a = x.a
WHERE x.a = x.b AND EXISTS (SELECT 1 FROM cl z WHERE z.method_id = x.method_id AND z.a = y.b AND z.b = x.a) GROUP BY 1, 2""")
def grf_components(spark, d):
    return G.components(B.clean_cfg(facts(spark, d))[1], M).select("method_id", "node", "component")


def cfg_ends(f):
    size = f["cfg_blocks"].groupBy(*M).agg(F.max("block_id").alias("target"))
    return size.select(*M, F.lit(1).alias("source"), "target")


_FIRST = f"""reach AS (SELECT {MK}, 1 AS node FROM f_size UNION SELECT r.project_id, r.scan_id, r.method_id, e.dst FROM reach r JOIN ce e ON {same('r', 'e')} AND e.src = r.node),
cut AS (SELECT s.project_id, s.scan_id, s.method_id, b.node AS gone, 1 AS node FROM f_size s JOIN reach b ON {same('s', 'b')} WHERE b.node <> 1
  UNION SELECT c.project_id, c.scan_id, c.method_id, c.gone, e.dst FROM cut c JOIN ce e ON {same('c', 'e')} AND e.src = c.node WHERE e.dst <> c.gone),
doms AS (SELECT r.project_id, r.scan_id, r.method_id, r.node, b.node AS dom FROM reach r JOIN reach b ON {same('r', 'b')}
  WHERE b.node = r.node OR b.node = 1 OR NOT EXISTS (SELECT 1 FROM cut c WHERE {same('c', 'r')} AND c.gone = b.node AND c.node = r.node))"""
_CE = f"ce AS (SELECT DISTINCT {MK}, src, dst FROM f_edges)"


@case("grf_dominators", fact_ctes(_CE, _FIRST) + "SELECT method_id, node, string_agg(CAST(dom AS STRING), ',' ORDER BY dom) AS doms FROM doms GROUP BY method_id, node")
def grf_dominators(spark, d):
    f = facts(spark, d)
    entry = f["cfg_blocks"].where("is_entry").select(*M, F.col("block_id").alias("node"))
    out = G.dominators(B.clean_cfg(f)[1], entry, M)
    return out.select("method_id", "node", F.array_join(F.transform("doms", lambda x: x.cast("string")), ",").alias("doms"))


@case("grf_on_all_paths", fact_ctes(_CE, _FIRST) + f"""
SELECT d.method_id, d.dom AS node FROM doms d JOIN f_size s ON {same('d', 's')} AND s.n = d.node WHERE d.dom <> 1 AND d.dom <> d.node""")
def grf_on_all_paths(spark, d):
    f = facts(spark, d)
    return G.on_all_paths(B.clean_cfg(f)[1], cfg_ends(f), M).select("method_id", "node")


_HIT = f"""marks AS (SELECT {MK}, pos AS node FROM f_nodes WHERE disc >= 5),
free AS (SELECT {MK}, 1 AS node FROM f_size s WHERE NOT EXISTS (SELECT 1 FROM marks k WHERE {same('k', 's')} AND k.node = 1)
  UNION SELECT r.project_id, r.scan_id, r.method_id, e.dst FROM free r JOIN ce e ON {same('r', 'e')} AND e.src = r.node
  WHERE NOT EXISTS (SELECT 1 FROM marks k WHERE {same('k', 'r')} AND k.node = e.dst)),
alln AS (SELECT {MK}, 1 AS node FROM f_size UNION SELECT r.project_id, r.scan_id, r.method_id, e.dst FROM alln r JOIN ce e ON {same('r', 'e')} AND e.src = r.node)"""


@case("grf_all_paths_hit", fact_ctes(_CE, _HIT) + f"""
SELECT s.method_id, s.n AS target, EXISTS (SELECT 1 FROM alln a WHERE {same('a', 's')} AND a.node = s.n) AND NOT EXISTS (SELECT 1 FROM free a WHERE {same('a', 's')} AND a.node = s.n) AS is_hit FROM f_size s""")
def grf_all_paths_hit(spark, d):
    f = facts(spark, d)
    marked = V.flat(spark, d, "f_nodes")["f_nodes"].where("disc >= 5").select(*M, F.col("pos").cast("int").alias("node"))
    return G.all_paths_hit(B.clean_cfg(f)[1], cfg_ends(f), marked, M).select("method_id", "target", "is_hit")


_FWD = """fwd AS (SELECT DISTINCT method_id, source, source AS node FROM pairs UNION SELECT f.method_id, f.source, e.dst FROM fwd f JOIN s_edges2 e ON e.method_id = f.method_id AND e.src = f.node),
bwd AS (SELECT DISTINCT method_id, target, target AS node FROM pairs UNION SELECT b.method_id, b.target, e.src FROM bwd b JOIN s_edges2 e ON e.method_id = b.method_id AND e.dst = b.node)"""


@case("grf_on_any_path", step_ctes(_PAIRS, _E2, _FWD) + """
SELECT p.method_id, p.source, p.target, n.node_id AS node FROM pairs p JOIN s_nodes n ON n.method_id = p.method_id AND n.is_sanitizer
JOIN fwd f ON f.method_id = p.method_id AND f.source = p.source AND f.node = n.node_id JOIN bwd b ON b.method_id = p.method_id AND b.target = p.target AND b.node = n.node_id""")
def grf_on_any_path(spark, d):
    nodes, edges = steps(spark, d)
    marked = nodes.where("is_sanitizer").select("method_id", F.col("node_id").alias("node"))
    return G.on_any_path(edges, step_pairs(nodes), marked, SM)


@case("grf_topo_levels", step_ctes(_E2, "lv AS (SELECT method_id, node_id AS node, 0 AS level FROM s_nodes UNION SELECT l.method_id, e.dst, l.level + 1 FROM lv l JOIN s_edges2 e ON e.method_id = l.method_id AND e.src = l.node)") + """
SELECT method_id, node, max(level) AS level, false AS is_cyclic FROM lv GROUP BY 1, 2""")
def grf_topo_levels(spark, d):
    nodes, edges = steps(spark, d)
    return G.topo_levels(nodes.select("method_id", F.col("node_id").alias("node")), edges, SM)


_BFS = f"""bad AS (SELECT DISTINCT {MK} FROM cl WHERE a = b),
hop AS (SELECT {MK}, 1 AS node, 0 AS level FROM bad UNION SELECT h.project_id, h.scan_id, h.method_id, e.dst, h.level + 1 FROM hop h JOIN ce e ON {same('h', 'e')} AND e.src = h.node WHERE h.level < 20)"""


@case("grf_bfs_levels_cyclic", fact_ctes(_CL, _BFS) + "SELECT method_id, node, min(level) AS level FROM hop GROUP BY 1, 2")
def grf_bfs_levels_cyclic(spark, d):
    f = facts(spark, d)
    blocks, edges = B.clean_cfg(f)
    out = G.topo_levels(blocks.select(*M, F.col("block_id").alias("node")), edges, M, blocks.where("is_entry").select(*M, F.col("block_id").alias("node")))
    return out.where("is_cyclic").select("method_id", "node", "level")


@case("grf_taint_subgraph", step_ctes(_PAIRS, _E2, _FWD, """keep AS (SELECT DISTINCT p.method_id, f.node FROM pairs p JOIN fwd f ON f.method_id = p.method_id AND f.source = p.source
  JOIN bwd b ON b.method_id = p.method_id AND b.target = p.target AND b.node = f.node)""") + """
SELECT e.method_id, e.src, e.dst, e.edge_kind FROM s_edges e JOIN keep a ON a.method_id = e.method_id AND a.node = e.src JOIN keep b ON b.method_id = e.method_id AND b.node = e.dst""")
def grf_taint_subgraph(spark, d):
    nodes, edges = steps(spark, d)
    _, sub = G.taint_subgraph(nodes.withColumnRenamed("node_id", "node"), edges, SM, step_pairs(nodes))
    return sub.select("method_id", "src", "dst", "edge_kind")


@case("grf_tainted_neighbourhood", step_ctes("hot AS (SELECT method_id, node_id AS node FROM s_nodes WHERE is_source)",
      "keep AS (SELECT * FROM hot UNION SELECT e.method_id, e.dst FROM s_edges e JOIN hot h ON h.node = e.src)") + """
SELECT e.src, e.dst, e.edge_kind FROM s_edges e JOIN keep a ON a.node = e.src JOIN keep b ON b.node = e.dst""")
def grf_tainted_neighbourhood(spark, d):
    nodes, edges = steps(spark, d)
    _, sub = G.taint_subgraph(nodes.withColumnRenamed("node_id", "node").withColumn("is_tainted", F.col("is_source")), edges, SM)
    return sub.select("src", "dst", "edge_kind")


@case("grf_method_subgraph", step_ctes("pick AS (SELECT min(method_id) AS m FROM s_nodes)") + "SELECT e.src, e.dst, e.edge_kind FROM s_edges e JOIN pick ON pick.m = e.method_id")
def grf_method_subgraph(spark, d):
    nodes, edges = steps(spark, d)
    first = nodes.agg(F.min("method_id")).first()[0]
    return G.method_subgraph(nodes.withColumnRenamed("node_id", "node"), edges, SM, first)[1].select("src", "dst", "edge_kind")


@case("grf_graph_diff", step_ctes() + """
SELECT method_id, node_id AS node, unnest(list_filter([CASE WHEN value > 20 AND NOT is_source THEN 'newly_tainted' END, CASE WHEN is_sanitizer THEN 'sanitized' END,
  CASE WHEN value > 20 AND is_source THEN 'still_tainted' END], lambda x: x IS NOT NULL)) AS change FROM s_nodes""")
def grf_graph_diff(spark, d):
    nodes = steps(spark, d)[0].withColumnRenamed("node_id", "node")
    before = nodes.withColumn("is_tainted", F.col("is_source"))
    after = nodes.withColumn("is_tainted", F.col("value") > 20).withColumn("is_sanitized", F.col("is_sanitizer"))
    return G.graph_diff(before, after, SM)


@case("grf_stats", step_ctes() + """
SELECT 'total_nodes' AS metric, count(*) AS n FROM s_nodes UNION ALL SELECT 'total_edges', count(*) FROM s_edges UNION ALL SELECT 'node:' || kind, count(*) FROM s_nodes GROUP BY kind
UNION ALL SELECT 'edge:' || edge_kind, count(*) FROM s_edges GROUP BY edge_kind UNION ALL SELECT 'is_source', count(*) FROM s_nodes WHERE is_source
UNION ALL SELECT 'is_sink', count(*) FROM s_nodes WHERE is_sink UNION ALL SELECT 'is_sanitizer', count(*) FROM s_nodes WHERE is_sanitizer""")
def grf_stats(spark, d):
    nodes, edges = steps(spark, d)
    return G.graph_stats(nodes, edges, []).select("metric", "n")


@case("grf_priority_sample", step_ctes() + """
SELECT method_id, node_id AS node, priority FROM (SELECT *, row_number() OVER (PARTITION BY method_id ORDER BY priority, node_id) AS rn FROM (
  SELECT method_id, node_id, CASE WHEN is_sink AND value > 20 THEN 0 WHEN value > 20 THEN 1 WHEN is_source THEN 2 WHEN is_sink THEN 3 ELSE 4 END AS priority FROM s_nodes)) WHERE rn <= 5""")
def grf_priority_sample(spark, d):
    nodes = steps(spark, d)[0].withColumnRenamed("node_id", "node").withColumn("is_tainted", F.col("value") > 20)
    return G.priority_sample(nodes, SM, 5).select("method_id", "node", "priority")


@case("src_clean_graph", step_ctes() + """
SELECT e.src, e.dst FROM s_edges e JOIN s_nodes a ON a.node_id = e.src JOIN s_nodes b ON b.node_id = e.dst WHERE a.kind <> 'view' AND b.kind <> 'view'""")
def src_clean_graph(spark, d):
    nodes, edges = steps(spark, d)
    kind = F.when(F.col("kind") == "view", "VIEW").otherwise("METHOD_CALL")
    mk = lambda df: df.select(F.lit("p").alias("project_id"), F.lit("s").alias("scan_id"), "*")
    return clean_graph(mk(nodes.withColumnRenamed("node_id", "node")).withColumn("kind", kind), mk(edges))[1].select("src", "dst")


# --- taint ------------------------------------------------------------------------------


_SEEDP = f"""pc AS (SELECT p.project_id, p.scan_id, p.method_id, p.name, p.resolved_type, p.bindings, m.is_entry_point,
    (c.attrs LIKE '%ApiControllerAttribute%' OR c.name LIKE '%Controller' OR coalesce(c.base_class LIKE '%ControllerBase%', false)) AS ctrl
  FROM f_params p JOIN f_methods m ON {same('p', 'm')} JOIN f_classes c ON c.project_id = m.project_id AND c.class_id = m.class_id),
seedp AS (SELECT project_id, scan_id, method_id, 'p:' || method_id || ':' || name AS node,
  CASE WHEN is_entry_point OR bindings LIKE 'From%' THEN 'USER_INPUT' WHEN ctrl AND (contains(resolved_type, 'String') OR contains(resolved_type, 'string')) THEN 'USER_INPUT'
    ELSE coalesce((SELECT arg_min(label, ordinal) FROM {_SRC_SQL} r WHERE contains(resolved_type, prefix)), CASE WHEN contains(resolved_type, 'IFormFile') THEN 'USER_INPUT' END) END AS label FROM pc)"""
_SEEDN = f"""seedn AS (SELECT project_id, scan_id, method_id, 'n:' || node_id AS node,
  coalesce((SELECT arg_min(label, ordinal) FROM {_SRC_SQL} r WHERE starts_with(full_symbol, prefix)), 'USER_INPUT') AS label FROM f_role WHERE is_source AND NOT is_san)"""


@case("tnt_seed_parameters", fact_ctes(_SEEDP) + "SELECT node, label AS taint_label FROM seedp WHERE label IS NOT NULL")
def tnt_seed_parameters(spark, d):
    return T.seed_parameters(facts(spark, d), load_rules(spark)).select("node", "taint_label")


@case("tnt_seed_nodes", fact_ctes(_SEEDN) + "SELECT node, label AS taint_label FROM seedn")
def tnt_seed_nodes(spark, d):
    return T.seed_nodes(facts(spark, d), load_rules(spark)).select("node", "taint_label")


_MATCHES = """(lower(s.symbol) = lower(m.name) OR ends_with(lower(s.symbol), '.' || lower(m.name)) OR contains(lower(s.symbol), '.' || lower(m.name) || '(')
    OR ends_with(lower(s.symbol), lower(m.name) || 'async'))"""
_RET = f"""csym2 AS (SELECT DISTINCT project_id, scan_id, full_symbol AS symbol FROM f_nodes WHERE kind = 'InvocationExpression'),
callm AS (SELECT s.project_id, s.scan_id, s.symbol, m.method_id AS callee, m.ordinal FROM csym2 s JOIN f_methods m ON m.project_id = s.project_id AND {_MATCHES}),
retl AS (SELECT r.project_id, r.scan_id, r.method_id, n.line, n.node_id FROM f_returns r JOIN f_nodes n ON n.project_id = r.project_id AND n.node_id = r.node_id),
rete AS (SELECT DISTINCT c.project_id, c.scan_id, n.method_id, c.callee FROM f_nodes n JOIN callm c ON c.project_id = n.project_id AND c.symbol = n.full_symbol
  WHERE n.kind = 'InvocationExpression' AND EXISTS (SELECT 1 FROM retl l WHERE l.project_id = n.project_id AND l.method_id = n.method_id AND abs(l.line - n.line) <= 8)),
seedr AS (SELECT DISTINCT project_id, scan_id, method_id FROM f_returns WHERE may_return_tainted
  UNION SELECT m.project_id, m.scan_id, m.method_id FROM f_methods m WHERE lower(m.return_type) = 'string' AND m.name = 'ReadRequestBody'
    AND EXISTS (SELECT 1 FROM f_returns r WHERE r.project_id = m.project_id AND r.method_id = m.method_id)
    AND EXISTS (SELECT 1 FROM f_returns r WHERE r.project_id = m.project_id AND r.may_return_tainted)),
tret AS (SELECT * FROM seedr UNION SELECT e.project_id, e.scan_id, e.method_id FROM tret t JOIN rete e ON e.project_id = t.project_id AND e.callee = t.method_id)"""


@case("tnt_tainted_returns", fact_ctes(_RET) + "SELECT project_id, method_id FROM tret")
def tnt_tainted_returns(spark, d):
    return T.tainted_returns(facts(spark, d)).select("project_id", "method_id")


_CPAR = f"""tcall AS (SELECT DISTINCT c.project_id, c.symbol FROM callm c JOIN tret t ON t.project_id = c.project_id AND t.method_id = c.callee),
firstm AS (SELECT project_id, symbol, arg_min(callee, ordinal) AS callee FROM callm GROUP BY 1, 2),
cpar AS (SELECT DISTINCT p.project_id, p.scan_id, p.method_id, p.name AS parameter_name FROM f_role n JOIN args a ON a.node_id = n.node_id
  JOIN firstm f ON f.project_id = n.project_id AND f.symbol = n.full_symbol JOIN f_params p ON p.project_id = n.project_id AND p.method_id = f.callee AND p.position = a.position
  WHERE n.kind = 'InvocationExpression' AND ((NOT a.lit AND a.origin IN ('parameter', 'return_value', 'unknown')) OR EXISTS (
    SELECT 1 FROM f_nodes o JOIN tcall t ON t.project_id = o.project_id AND t.symbol = o.full_symbol WHERE o.project_id = n.project_id AND o.node_id = a.onode AND o.kind = 'InvocationExpression')))"""


@case("tnt_callee_parameters", fact_ctes(ARGS, _RET, _CPAR) + "SELECT method_id, parameter_name FROM cpar")
def tnt_callee_parameters(spark, d):
    f = facts(spark, d)
    return T.tainted_callee_params(f, checkpoint(T.tainted_returns(f))).select("method_id", "parameter_name")


def step_keys(df):
    return df.select(F.lit("p").alias("project_id"), F.lit("s").alias("scan_id"), "*")


def _named(nodes, flag):
    return step_keys(nodes.where(flag).select("method_id", F.col("node_id").alias("node")))


_PROP = """tn AS (SELECT method_id, node_id AS node FROM s_nodes WHERE is_source UNION SELECT e.method_id, e.dst FROM tn JOIN s_edges e ON e.method_id = tn.method_id AND e.src = tn.node
  JOIN s_nodes n ON n.node_id = e.dst WHERE NOT n.is_sanitizer)"""


@case("tnt_propagate", step_ctes(_PROP) + "SELECT tn.method_id, tn.node, n.is_sink FROM tn JOIN s_nodes n ON n.node_id = tn.node")
def tnt_propagate(spark, d):
    nodes, edges = steps(spark, d)
    hit = T.propagate(step_keys(edges), _named(nodes, "is_source"), _named(nodes, "is_sanitizer")).select(*M, "node")
    sinks = T.tainted_sinks(hit, _named(nodes, "is_sink")).withColumn("_s", F.lit(True))
    return hit.join(sinks, [*M, "node"], "left").select("method_id", "node", F.coalesce("_s", F.lit(False)).alias("is_sink"))


@case("tnt_nearest_origin", step_ctes(_E2, """og AS (SELECT method_id, node_id AS source, node_id AS node, 0 AS depth FROM s_nodes WHERE is_source
  UNION SELECT o.method_id, o.source, e.dst, o.depth + 1 FROM og o JOIN s_edges2 e ON e.method_id = o.method_id AND e.src = o.node)""") + """
SELECT o.method_id, o.node, arg_min(o.source, struct_pack(a := o.depth, b := o.source)) AS source, min(o.depth) AS hops FROM og o JOIN s_nodes n ON n.node_id = o.node WHERE n.is_sink GROUP BY 1, 2""")
def tnt_nearest_origin(spark, d):
    nodes, edges = steps(spark, d)
    near = T.nearest_origin(step_keys(edges), _named(nodes, "is_source"))
    return near.join(_named(nodes, "is_sink"), [*M, "node"], "left_semi").select("method_id", "node", "source", (F.size("path") - 1).alias("hops"))


@case("tnt_host_whitelist", fact_ctes() + f"""
SELECT method_id FROM f_nodes GROUP BY {MK} HAVING bool_or(contains(lower(text), '.host') AND (contains(lower(text), 'contains(') OR contains(lower(text), 'indexof(')))
  AND bool_or(contains(lower(text), 'whitelist') OR contains(lower(text), 'allowedhost'))""")
def tnt_host_whitelist(spark, d):
    return T.has_host_whitelist(B.method_nodes(facts(spark, d))).select("method_id")


_INTER = f"""ctret AS (SELECT c.project_id, c.symbol, arg_min(c.callee, c.ordinal) AS callee FROM callm c JOIN tret t ON t.project_id = c.project_id AND t.method_id = c.callee GROUP BY 1, 2),
inter AS (SELECT DISTINCT c.node_id AS call_id, s.node_id AS sink_id FROM f_role c JOIN ctret t ON t.project_id = c.project_id AND t.symbol = c.full_symbol
  JOIN f_role s ON {same('s', 'c')} AND s.is_sink JOIN args a ON a.node_id = s.node_id
  WHERE c.kind = 'InvocationExpression' AND (a.onode = c.node_id OR (a.origin = 'return_value' AND abs(s.line - c.line) <= 5)))"""


@case("tnt_interprocedural", fact_ctes(ARGS, _RET, _INTER) + "SELECT 'n:' || call_id AS source_node_id, 'n:' || sink_id AS sink_node_id FROM inter")
def tnt_interprocedural(spark, d):
    f = B.written(facts(spark, d))
    return T.interproc_findings(f, checkpoint(T.tainted_returns(f)), load_sink_kinds(spark)).select("source_node_id", "sink_node_id")


_STR = f"""sb AS (SELECT * FROM live WHERE (source_text LIKE '"SELECT "%' OR source_text LIKE '$"cmd%' OR (regexp_matches(source_text, '"[^"]*"') AND contains(source_text, '+')))),
strf AS (SELECT b.assignment_id, s.node_id, (SELECT arg_min(vk, ordinal) FROM {_SINKS_SQL} r WHERE starts_with(s.full_symbol, prefix)) AS kind
  FROM sb b JOIN f_role s ON {same('b', 's')} AND s.is_sink AND abs(s.line - b.line) <= 10
  WHERE s.nargs > 0 AND NOT s.a0_lit AND s.a0_origin <> 'literal' AND NOT starts_with(s.a0_text, '"')
    AND (s.a0_text = b.target_name OR (b.target_name <> '__string_concat' AND contains(s.a0_text, b.target_name))
      OR (b.target_name = '__string_concat' AND regexp_matches(s.a0_text, '"[^"]*"') AND contains(s.a0_text, '+')))
    AND NOT EXISTS (SELECT 1 FROM f_role z WHERE {same('z', 's')} AND z.is_san AND z.line BETWEEN b.line AND s.line))"""


@case("tnt_string_injection", fact_ctes(LIVE, _STR) + "SELECT 'a:' || assignment_id AS source_node_id, 'n:' || node_id AS sink_node_id, kind AS vulnerability_kind FROM strf WHERE kind IN ('SQL_INJECTION', 'COMMAND_INJECTION')")
def tnt_string_injection(spark, d):
    return T.string_injection(facts(spark, d), load_sink_kinds(spark)).select("source_node_id", "sink_node_id", "vulnerability_kind")


# the full intra-method question: seeds, blocked spread, nearest origin, guards, control flow
_FLOW = f"""seeds AS (SELECT project_id, scan_id, method_id, node FROM seedp WHERE label IS NOT NULL
    UNION SELECT project_id, scan_id, method_id, 'p:' || method_id || ':' || parameter_name FROM cpar UNION SELECT project_id, scan_id, method_id, node FROM seedn),
sans AS (SELECT {MK}, 'n:' || node_id AS node, pos, line FROM f_role WHERE is_san),
de AS (SELECT DISTINCT n.project_id, n.scan_id, n.method_id, g.src, g.dst FROM (SELECT * FROM dfg) g JOIN (
    SELECT {MK}, 'n:' || node_id AS id FROM f_nodes UNION ALL SELECT {MK}, 'a:' || assignment_id FROM live) n ON n.id = g.dst),
spread AS (SELECT project_id, scan_id, method_id, node FROM seeds UNION SELECT e.project_id, e.scan_id, e.method_id, e.dst FROM spread s
  JOIN de e ON {same('e', 's')} AND e.src = s.node WHERE NOT EXISTS (SELECT 1 FROM sans z WHERE {same('z', 's')} AND (z.node = e.dst OR z.node = e.src))),
near AS (SELECT project_id, scan_id, method_id, node AS source, node, 0 AS depth FROM seeds
  UNION SELECT e.project_id, e.scan_id, e.method_id, n.source, e.dst, n.depth + 1 FROM near n JOIN de e ON {same('e', 'n')} AND e.src = n.node WHERE n.depth < 24),
orig AS (SELECT project_id, scan_id, method_id, node, arg_min(source, struct_pack(a := depth, b := source)) AS source, min(depth) AS depth FROM near GROUP BY ALL),
hit AS (SELECT r.project_id, r.scan_id, r.method_id, o.node, o.source, o.depth, r.pos, r.line, coalesce((SELECT arg_min(vk, ordinal) FROM {_SINKS_SQL} k WHERE starts_with(r.full_symbol, prefix)), 'UNKNOWN') AS kind
  FROM f_role r JOIN spread s ON {same('s', 'r')} AND s.node = 'n:' || r.node_id JOIN orig o ON {same('o', 'r')} AND o.node = s.node
  WHERE r.is_sink AND NOT (r.nargs > 0 AND r.a0_lit)),
src AS (SELECT h.*, CAST(n.pos AS INT) AS spos FROM hit h LEFT JOIN f_nodes n ON 'n:' || n.node_id = h.source),
ce AS (SELECT DISTINCT {MK}, src, dst FROM f_edges),
okk AS (SELECT DISTINCT project_id, scan_id, method_id, spos, spos AS node FROM src WHERE spos IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sans z WHERE {same('z', 'src')} AND z.pos = spos)
  UNION SELECT c.project_id, c.scan_id, c.method_id, k.spos, c.dst FROM okk k JOIN ce c ON {same('c', 'k')} AND c.src = k.node WHERE NOT EXISTS (SELECT 1 FROM sans z WHERE {same('z', 'k')} AND z.pos = c.dst)),
anyp AS (SELECT DISTINCT project_id, scan_id, method_id, spos, spos AS node FROM src WHERE spos IS NOT NULL
  UNION SELECT c.project_id, c.scan_id, c.method_id, k.spos, c.dst FROM anyp k JOIN ce c ON {same('c', 'k')} AND c.src = k.node),
flow AS (SELECT s.*, CASE WHEN depth + 1 <= 2 THEN 'confirmed' WHEN depth + 1 <= 4 THEN 'high' WHEN starts_with(source, 'p:') THEN 'high' ELSE 'medium' END AS confidence FROM src s
  WHERE NOT (kind = 'SSRF' AND EXISTS (SELECT 1 FROM hostg g WHERE {same('g', 's')}))
    AND NOT (spos IS NOT NULL AND EXISTS (SELECT 1 FROM sans z WHERE {same('z', 's')}) AND EXISTS (SELECT 1 FROM anyp a WHERE {same('a', 's')} AND a.spos = s.spos AND a.node = s.pos)
      AND NOT EXISTS (SELECT 1 FROM okk a WHERE {same('a', 's')} AND a.spos = s.spos AND a.node = s.pos)))"""
FLOW_CTES = (*DFG_CTES, DFG_SQL, _SEEDP, _SEEDN, _RET, _CPAR, _GUARDS, _FLOW)


def _flow_inputs(spark, d):
    f = B.written(facts(spark, d))
    rules = load_rules(spark)
    returns = checkpoint(T.tainted_returns(f))
    seeds = checkpoint(T.taint_seeds(f, rules, T.tainted_callee_params(f, returns)))
    return f, rules, returns, seeds


@case("tnt_flow_findings", fact_ctes(*FLOW_CTES) + "SELECT source AS source_node_id, node AS sink_node_id, kind AS vulnerability_kind, confidence FROM flow")
def tnt_flow_findings(spark, d):
    f, rules, _, seeds = _flow_inputs(spark, d)
    out = T.flow_findings(f, rules, load_sink_kinds(spark), checkpoint(B.build_dfg(f).select(*M, "src", "dst")), seeds)
    return out.select("source_node_id", "sink_node_id", "vulnerability_kind", "confidence")


@case("tnt_findings", fact_ctes(*FLOW_CTES, _INTER, _STR) + """
SELECT source_node_id, sink_node_id, min(rank) AS confidence_rank FROM (
  SELECT source AS source_node_id, node AS sink_node_id, CASE confidence WHEN 'confirmed' THEN 0 WHEN 'high' THEN 1 ELSE 2 END AS rank FROM flow
  UNION ALL SELECT 'n:' || call_id, 'n:' || sink_id, 2 FROM inter UNION ALL SELECT 'a:' || assignment_id, 'n:' || node_id, 1 FROM strf WHERE kind IN ('SQL_INJECTION', 'COMMAND_INJECTION')) GROUP BY 1, 2""")
def tnt_findings(spark, d):
    from taintgrid.functions.columns import confidence_rank

    out = T.taint_findings(facts(spark, d), load_rules(spark), load_sink_kinds(spark))
    return out.select("source_node_id", "sink_node_id", confidence_rank().alias("confidence_rank"))


# --- weighted propagation -----------------------------------------------------------------


def step_graph(spark, d):
    """Event walks as a unified graph: views are lambdas, errors partial sanitizers, late hours loops."""
    nodes, edges = steps(spark, d)
    kind = F.when(F.col("kind") == "view", "LAMBDA_CAPTURE").when(F.col("kind") == "click", "COLLECTION_ITEM").otherwise("METHOD_CALL")
    n = nodes.select(
        "method_id", F.col("node_id").alias("node"), kind.alias("kind"), "is_source", "is_sink", "is_sanitizer", (F.col("value") > 60).alias("is_in_loop"),
        (F.col("line") % 5 == 0).alias("is_async"), "value")
    return n, edges


def step_effect(nodes):
    """Errors sanitise: strongly when the value is large."""
    return nodes.where("is_sanitizer").select(
        "method_id", "node", F.when(F.col("value") > 30, 0.95).otherwise(0.7).alias("san_confidence"), F.array(F.lit("SQL_INJECTION")).alias("san_kinds"))


_WN = """wn AS MATERIALIZED (SELECT method_id, node_id AS node, CASE kind WHEN 'view' THEN 'LAMBDA_CAPTURE' WHEN 'click' THEN 'COLLECTION_ITEM' ELSE 'METHOD_CALL' END AS kind,
  is_source, is_sink, is_sanitizer, value > 60 AS in_loop, line % 5 = 0 AS is_async, value FROM s_nodes)"""
# one hop: from walk x over edge e to node n
_STEP_CONF = """round(x.conf * ((CASE WHEN e.is_conditional THEN 0.80 ELSE 1.0 END) * (CASE WHEN e.edge_kind = 'aliases' THEN 0.92 ELSE 1.0 END) * (CASE WHEN n.in_loop THEN 0.90 ELSE 1.0 END)
      * (CASE WHEN n.kind = 'COLLECTION_ITEM' THEN 0.85 ELSE 1.0 END) * (CASE WHEN n.kind = 'LAMBDA_CAPTURE' THEN 0.88 ELSE 1.0 END)
      * (CASE WHEN x.partial THEN 0.75 ELSE 1.0 END) * (CASE WHEN x.depth > 5 THEN pow(0.95, x.depth - 5) ELSE 1.0 END))::DOUBLE + 1e-9, 4)"""
# all walks, those of equal state counted: fate as in the operator; walks go forward in time, so none has a cycle
_WEIGHT = f"""wx AS (SELECT method_id, node AS source, node, CAST(1.0 AS DOUBLE) AS conf, false AS partial, 'go' AS fate, 0 AS depth, 1::BIGINT AS n FROM wn WHERE is_source
  UNION ALL SELECT method_id, source, node, conf, partial, fate, depth, sum(n)::BIGINT FROM (
    SELECT x.method_id, x.source, e.dst AS node, {_STEP_CONF} AS conf, n.is_sanitizer AS partial,
      CASE WHEN {_STEP_CONF} < 0.3 THEN 'weak' WHEN n.is_sanitizer AND n.value > 30 THEN 'blocked' WHEN n.is_sink THEN 'sink' ELSE 'go' END AS fate, x.depth + 1 AS depth, x.n
    FROM wx x JOIN s_edges e ON e.method_id = x.method_id AND e.src = x.node JOIN wn n ON n.node = e.dst WHERE x.fate = 'go') q GROUP BY ALL)"""


def weighted_inputs(spark, d):
    n, edges = step_graph(spark, d)
    return n, edges, n.where("is_source").select("method_id", "node", F.lit("USER_INPUT").alias("taint_label"))


@case("tnt_weighted", step_ctes(_WN, _WEIGHT) + "SELECT source, node AS sink, max(conf) AS confidence FROM wx WHERE fate = 'sink' GROUP BY 1, 2")
def tnt_weighted(spark, d):
    n, edges, src = weighted_inputs(spark, d)
    out = W.propagate_weighted(n, edges, src, SM, step_effect(n))
    return W.dedupe_weighted(out, SM).select("source", "sink", "confidence")


@case("tnt_weighted_paths", step_ctes(_WN, _WEIGHT) + "SELECT source, node AS sink, sum(n)::BIGINT AS n, max(conf) AS confidence FROM wx WHERE fate = 'sink' GROUP BY 1, 2")
def tnt_weighted_paths(spark, d):
    n, edges, src = weighted_inputs(spark, d)
    out = W.propagate_weighted(n, edges, src, SM, step_effect(n), mode="all")
    return out.groupBy("source", "sink").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


# the best walk per source, node and level, with what its tags and texts need
_BEST = f"""wb AS (SELECT method_id, node AS source, node, 0 AS depth, {{'conf': CAST(1.0 AS DOUBLE), 'cond': false, 'asyn': false, 'partial': false, 'path': [node], 'lam': false, 'coll': false, 'sum': CAST(node AS VARCHAR)}} AS s, false AS stop,
    false AS was_cond, false AS was_async, false AS was_partial FROM wn WHERE is_source
  UNION ALL SELECT method_id, source, node, depth, arg_min(s, struct_pack(a := -s.conf, b := was_cond, c := s.path)), stop, arg_min(was_cond, struct_pack(a := -s.conf, b := was_cond, c := s.path)),
    arg_min(was_async, struct_pack(a := -s.conf, b := was_cond, c := s.path)), arg_min(was_partial, struct_pack(a := -s.conf, b := was_cond, c := s.path)) FROM (
    SELECT x.method_id, x.source, e.dst AS node, x.depth + 1 AS depth, n.is_sink AS stop, x.cond AS was_cond, x.asyn AS was_async, x.partial AS was_partial,
      {{'conf': {_STEP_CONF}, 'cond': x.cond OR e.is_conditional, 'asyn': x.asyn OR n.is_async, 'partial': n.is_sanitizer, 'path': list_append(x.path, e.dst),
        'lam': x.lam OR n.kind = 'LAMBDA_CAPTURE', 'coll': x.coll OR n.kind = 'COLLECTION_ITEM',
        'sum': x.sum || ' -> ' || e.dst || ' [' || e.edge_kind || ']' || CASE WHEN e.is_conditional THEN ' (conditional)' ELSE '' END}} AS s
    FROM (SELECT method_id, source, node, depth, stop, unnest(s) FROM wb) x JOIN s_edges e ON e.method_id = x.method_id AND e.src = x.node JOIN wn n ON n.node = e.dst
    WHERE NOT x.stop AND NOT (n.is_sanitizer AND n.value > 30) AND {_STEP_CONF} >= 0.3) q GROUP BY method_id, source, node, depth, stop),
bestw AS (SELECT source, node AS sink, s.conf AS conf, s.sum AS summary, was_cond, list_filter([CASE WHEN was_async THEN 'async_taint_flow' END, CASE WHEN s.lam THEN 'lambda_capture_taint' END, CASE WHEN s.coll THEN 'collection_taint_flow' END,
    CASE WHEN was_partial THEN 'partial_sanitizer_bypass' END, CASE WHEN wn.in_loop THEN 'sink_in_loop' END], lambda t: t IS NOT NULL) AS tags
  FROM wb JOIN wn USING (node) WHERE stop QUALIFY row_number() OVER (PARTITION BY source, node ORDER BY s.conf DESC, depth, s.path) = 1)"""
_ADVICE = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.TAG_ADVICE.items()) + " END"


@case("tnt_weighted_tags", step_ctes(_WN, _BEST) + f"""
SELECT source, sink, array_to_string(tags, ',') AS tags, summary, array_to_string(list_transform(tags, lambda t: {_ADVICE}), ' ') AS advice, NOT was_cond AND conf >= 0.85 AS is_definitely_reachable FROM bestw""")
def tnt_weighted_tags(spark, d):
    n, edges, src = weighted_inputs(spark, d)
    best = W.dedupe_weighted(W.weighted_results(W.propagate_weighted(n, edges, src, SM, step_effect(n)), n, SM), SM)
    return W.path_summary(best).select("source", "sink", F.array_join("tags", ",").alias("tags"), "summary", "advice", "is_definitely_reachable")


@case("tnt_weighted_stats", step_ctes(_WN, _WEIGHT, _BEST) + """
SELECT (SELECT count(*) FROM wn WHERE is_source) AS sources, (SELECT count(*) FROM bestw) AS results, (SELECT count(*) FROM bestw WHERE list_contains(tags, 'sink_in_loop')) AS loop_flows,
  (SELECT count(*) FROM bestw WHERE list_contains(tags, 'async_taint_flow')) AS async_flows, (SELECT count(*) FROM bestw WHERE list_contains(tags, 'partial_sanitizer_bypass')) AS partial_sanitizers,
  sum(n) FILTER (fate = 'go')::BIGINT AS visited, sum(n) FILTER (fate = 'blocked')::BIGINT AS blocked, 0::BIGINT AS cycles, sum(n) FILTER (fate = 'weak')::BIGINT AS weak, 0::BIGINT AS depth_hits,
  max(depth) FILTER (fate IN ('go', 'sink')) AS deepest, 0::BIGINT AS inter_procedural FROM wx""")
def tnt_weighted_stats(spark, d):
    """Counters over all walks; results and their flags over the best walk of each source and sink."""
    n, edges, src = weighted_inputs(spark, d)
    every, levels = W.propagate_counted(n, edges, src, SM, step_effect(n), mode="all")
    best = W.dedupe_weighted(W.weighted_results(every, n, SM), SM)
    return W.propagation_stats(best, src, n, [], levels).select(
        "sources", "results", "loop_flows", "async_flows", "partial_sanitizers", "visited", "blocked", "cycles", "weak", "depth_hits", "deepest", "inter_procedural")


@case("tnt_sanitizer_effect", fact_ctes("san AS (SELECT DISTINCT full_symbol AS symbol FROM f_role WHERE is_san)") + """
SELECT symbol, CASE symbol WHEN 'System.IO.Path.GetFileName' THEN 0.80 WHEN 'System.IO.Path.GetFullPath' THEN 0.82 WHEN 'System.Net.WebUtility.HtmlEncode' THEN 0.80 ELSE 1.0 END AS confidence,
  CASE WHEN symbol = 'System.Data.SqlClient.SqlParameter' THEN 'full' ELSE 'partial' END AS user_input,
  CASE WHEN symbol LIKE 'System.IO.Path%' THEN 'partial' END AS environment_input FROM san""")
def tnt_sanitizer_effect(spark, d):
    nodes = facts(spark, d)["nodes"].select(*KEYS, F.col("node_id").alias("node"), F.col("is_known_sanitizer").alias("is_sanitizer"), "resolved_symbol")
    eff = W.sanitizer_effect(nodes, load_rules(spark), KEYS)
    rows = eff.join(nodes.select(*KEYS, "node", "resolved_symbol"), [*KEYS, "node"])
    say = lambda label: W.sanitizer_decision(F.lit(label), F.col("san_confidence"), F.col("san_kinds"))
    return rows.select(
        F.col("resolved_symbol").alias("symbol"), F.col("san_confidence").alias("confidence"), say("USER_INPUT").alias("user_input"),
        say("ENVIRONMENT_INPUT").alias("environment_input")).distinct()


@case("tnt_graph_sources", fact_ctes(*DFG_CTES, DFG_SQL) + f"""
SELECT DISTINCT node FROM (SELECT 'n:' || node_id AS node FROM f_role WHERE is_source AND NOT is_sink
  UNION ALL SELECT 'p:' || p.method_id || ':' || p.name FROM f_params p JOIN f_methods m ON {same('p', 'm')} WHERE m.is_entry_point
    OR EXISTS (SELECT 1 FROM f_role r WHERE {same('r', 'p')} AND r.is_source)
  UNION ALL SELECT g.dst FROM dfg g JOIN f_role r ON 'n:' || r.node_id = g.src AND r.is_source JOIN live a ON 'a:' || a.assignment_id = g.dst
    WHERE contains(a.target_name, 'interpolated') OR contains(a.target_name, 'concat')) WHERE node IS NOT NULL""")
def tnt_graph_sources(spark, d):
    f = facts(spark, d)
    # edges between methods end at calls, never at string builds, so the edges inside methods are all that can matter
    return W.graph_sources(B.unified_graph(f)[0], B.build_dfg(f), KEYS, f["methods"].where("is_entry_point")).select("node")


@case("bld_loop_nodes", fact_ctes(_CL) + f"SELECT DISTINCT 'n:' || n.node_id AS node FROM f_nodes n JOIN cl ON {same('cl', 'n')} AND cl.a = n.pos WHERE cl.a = cl.b")
def bld_loop_nodes(spark, d):
    return B.loop_nodes(facts(spark, d)).select("node")
