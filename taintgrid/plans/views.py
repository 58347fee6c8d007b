"""Fact tables derived from the star-schema tables by fixed rules.

The rules are plain SQL that Spark and an ANSI checker both read, so a query and its check see the
same facts. Only row numbers differ: Spark numbers rows with `ranked`, the checker with a window.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgrid.operators.prefix import with_roles
from taintgrid.session import checkpoint, ranked, ranked_by_key
from taintgrid.sources.catalog import ROLE_SANITIZERS, ROLE_SINKS, ROLE_SOURCES, load_roles

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
    "benchmark", "labels", "conversations",
]

# Symbols and texts the derived calls use: (k, symbol, text before the bracket).
CALLS = [
    ("System.Data.SqlClient.SqlCommand.ExecuteReader", "cmd.ExecuteReader"),
    ("Microsoft.AspNetCore.Http.HttpRequest.Query", "Request.Query"),
    ("System.IO.File.ReadAllText", "File.ReadAllText"),
    ("System.IO.Path.GetFileName", "Path.GetFileName"),
    ("System.Net.Http.HttpClient.GetAsync", "client.GetAsync"),
    ("System.Diagnostics.Process.Start", "Process.Start"),
    ("System.Data.SqlClient.SqlParameter", "new SqlParameter"),
    ("App.Orders.Svc.Op", "svc.Op"),
    ("System.Console.ReadLine", "Console.ReadLine"),
    ("System.Security.Cryptography.MD5.Create", "MD5.Create"),
    ("System.Runtime.Serialization.Formatters.Binary.BinaryFormatter.Deserialize", "fmt.Deserialize"),
    ("System.Random.Next", "rnd.Next"),
    ("Microsoft.AspNetCore.Mvc.ControllerBase.Redirect", "Redirect"),
    ("Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.FromSqlRaw", "ctx.Rows.FromSqlRaw"),
    ("System.Linq.Enumerable.Where", "rows.Where"),
    ("System.Xml.XmlDocument.Load", "doc.Load"),
    ("Newtonsoft.Json.JsonConvert.DeserializeObject", "JsonConvert.DeserializeObject"),
    ("System.ServiceModel.BasicHttpBinding..ctor", "new BasicHttpBinding"),
    ("System.String.Trim", "s.Trim"),
    ("System.Net.WebUtility.HtmlEncode", "WebUtility.HtmlEncode"),
    ("System.Array.IndexOf", "Array.IndexOf(allowedHosts, uri.Host); allowed.Contains"),
    ("System.Diagnostics.ProcessStartInfo.UseShellExecute", "psi.UseShellExecute = false; psi.ArgumentList.Add"),
    ("System.IO.Path.GetFullPath", "Path.GetFullPath"),
    ("Load", "xmlDocument.Load"),
    ("App.Web.Check", "ModelState.IsValid"),
    ("App.Web.Cors", "policy.AllowAnyOrigin"),
    ("App.Web.Cors", "policy.AllowCredentials"),
    ("App.Web.Binding", "binding.Security.Mode = None"),
    ("System.Type.GetType", "Type.GetType"),
    ("ToString", "Request.Query[id].ToString"),
]

_LI = """
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_shipdate) AS pos FROM lineitem)
"""
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def _values(rows: list[tuple], names: str) -> str:
    def lit(v):
        return str(v) if isinstance(v, (int, float)) else "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS t({names}))"


_CALL_TABLE = _values([(i, s, t) for i, (s, t) in enumerate(CALLS)], "k, base_symbol, txt")

# Flat facts; each entry may use the ones before it.
FACTS = {
    "calls": f"SELECT * FROM {_CALL_TABLE} c",
    "f_methods": """
SELECT 'p' || CAST(o_custkey % 7 AS STRING) AS project_id, 's1' AS scan_id, o_orderkey AS ordinal,
  'm' || CAST(o_orderkey AS STRING) AS method_id,
  CASE WHEN o_orderkey % 101 = 0 THEN 'ReadRequestBody' WHEN o_orderkey % 10 = 3 THEN 'MakeToken' || CAST(o_orderkey % 30 AS STRING)
    ELSE 'Op' || CAST(o_orderkey % 2000 AS STRING) END AS name,
  CASE WHEN o_orderstatus = 'F' THEN 'string' ELSE 'IActionResult' END AS return_type,
  o_orderstatus = 'P' AS is_async,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'HttpPostAttribute' WHEN '2-HIGH' THEN 'HttpGetAttribute'
    WHEN '3-MEDIUM' THEN 'HttpPutAttribute,ValidateAntiForgeryTokenAttribute'
    WHEN '4-NOT SPECIFIED' THEN 'AllowAnonymousAttribute,RouteAttribute' ELSE '' END AS attrs,
  'src/c' || CAST(o_custkey AS STRING) || '.cs' AS file, (o_orderkey % 100) * 40 AS line_start,
  o_orderstatus = 'O' AS is_entry_point, 'c' || CAST(o_custkey AS STRING) AS class_id, o_custkey, o_orderkey,
  o_orderpriority
FROM orders""",
    "f_classes": """
SELECT 'p' || CAST(c_custkey % 7 AS STRING) AS project_id, 's1' AS scan_id, c_custkey AS ordinal,
  'c' || CAST(c_custkey AS STRING) AS class_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Acct' || CAST(c_custkey AS STRING) || 'Controller' ELSE 'Svc' || CAST(c_custkey AS STRING) END AS name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Microsoft.AspNetCore.Mvc.ControllerBase' WHEN 'MACHINERY' THEN 'System.Object' END AS base_class,
  CASE c_nationkey % 5 WHEN 0 THEN 'ApiControllerAttribute' WHEN 1 THEN 'AuthorizeAttribute'
    WHEN 2 THEN 'AuthorizeAttribute,RouteAttribute' ELSE '' END AS attrs
FROM customer""",
    "f_params": """
SELECT project_id, scan_id, method_id, 'p0' AS name, 0 AS position,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'System.String' WHEN '2-HIGH' THEN 'System.Int32'
    WHEN '3-MEDIUM' THEN 'Microsoft.AspNetCore.Http.IFormFile' WHEN '4-NOT SPECIFIED' THEN 'App.Models.OrderModel'
    ELSE 'Microsoft.AspNetCore.Http.HttpRequest' END AS resolved_type,
  CASE o_orderkey % 3 WHEN 0 THEN 'FromQueryAttribute' WHEN 1 THEN 'RequiredAttribute' ELSE '' END AS bindings
FROM f_methods
UNION ALL
SELECT project_id, scan_id, method_id, 'p1', 1, 'System.Int32', '' FROM f_methods WHERE o_orderkey % 2 = 0""",
    "f_raw": """
SELECT m.project_id, m.scan_id, l.l_orderkey * 100 + l.pos AS ordinal, m.method_id, m.class_id, m.file, l.pos, l.l_orderkey,
  l.l_partkey, l.l_suppkey, l.l_returnflag, l.l_linestatus, CAST(l.l_quantity AS INT) AS q,
  CAST(round(l.l_discount * 100) AS INT) AS disc, CAST(round(l.l_tax * 100) AS INT) AS tax,
  'n' || CAST(l.l_orderkey AS STRING) || '_' || CAST(l.pos AS STRING) AS node_id,
  CAST(m.line_start + l.pos * 3 AS INT) AS line, c.k, c.txt,
  CASE WHEN c.k = 7 AND l.l_suppkey % 2 = 0 THEN 'App.Svc' || CAST(m.o_custkey AS STRING) || '.' || m.name
    WHEN c.k = 7 THEN c.base_symbol || CAST(l.l_suppkey % 20 AS STRING) ELSE c.base_symbol END AS symbol,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 'ObjectCreationExpression'
    WHEN l.l_returnflag = 'N' AND l.l_quantity > 44 THEN 'ReturnStatement' ELSE 'InvocationExpression' END AS kind
FROM li l JOIN f_methods m ON m.o_orderkey = l.l_orderkey JOIN calls c ON c.k = l.l_partkey % 30""",
    "f_args": """
SELECT *, CASE WHEN tax < 2 THEN 0 WHEN tax < 5 THEN 1 ELSE 2 END AS nargs,
  CASE q % 6 WHEN 0 THEN 'parameter' WHEN 1 THEN 'local_variable' WHEN 2 THEN 'return_value' WHEN 3 THEN 'field'
    WHEN 4 THEN 'unknown' ELSE 'literal' END AS a0_origin,
  CASE q % 6 WHEN 0 THEN 'p0' WHEN 1 THEN 'v' || CAST(l_suppkey % 3 AS STRING) WHEN 2 THEN 'Get()' WHEN 3 THEN 'p0.Name'
    WHEN 4 THEN 'x + "a"' ELSE '"lit"' END AS a0_text,
  q % 6 = 5 OR disc < 2 AS a0_lit,
  CASE WHEN q % 6 = 0 THEN 'p0' END AS a0_param,
  CASE WHEN q % 6 = 2 AND pos > 1 THEN 'n' || CAST(l_orderkey AS STRING) || '_' || CAST(pos - 1 AS STRING) END AS a0_node,
  disc > 8 AS a1_lit
FROM f_raw""",
    "f_nodes": """
SELECT *, txt || '(' || CASE WHEN nargs > 0 THEN a0_text ELSE '' END || ')' AS text,
  CASE WHEN k = 29 THEN 'Microsoft.AspNetCore.Http.IQueryCollection[indexer]' WHEN k = 23 THEN 'System.Xml.XmlDocument.Load'
    ELSE symbol END AS full_symbol,
  l_linestatus = 'O' AND q % 5 = 0 AS is_async_call, q % 4 = 0 AS is_in_try
FROM f_args""",
    "f_assign": """
SELECT project_id, scan_id, ordinal, method_id, 'a' || CAST(l_orderkey AS STRING) || '_' || CAST(pos AS STRING) AS assignment_id,
  CASE WHEN l_partkey % 50 = 7 THEN 'apiToken' WHEN l_partkey % 5 = 0 THEN '__string_concat'
    WHEN l_partkey % 5 = 1 THEN '__interpolated_string' WHEN l_partkey % 5 = 2 THEN '__collection_add'
    ELSE 'v' || CAST(l_suppkey % 3 AS STRING) END AS target_name,
  CASE WHEN tax < 6 THEN node_id END AS source_node_id,
  CASE WHEN l_partkey % 50 = 7 THEN '"s3cr' || CAST(l_partkey AS STRING) || '"' WHEN l_partkey % 4 = 0 THEN '"SELECT " + p0'
    WHEN l_partkey % 4 = 1 THEN '$"cmd " + p0' WHEN l_partkey % 4 = 2 THEN text ELSE 'p0' END AS source_text,
  l_partkey % 50 = 7 OR disc > 8 AS is_literal,
  CASE WHEN l_returnflag = 'A' THEN line + 1 ELSE line END AS line
FROM f_nodes WHERE l_linestatus = 'F'""",
    "f_used": "SELECT project_id, scan_id, method_id, 'p0' AS parameter_name, node_id FROM f_nodes WHERE q % 7 = 0",
    "f_assigned": "SELECT project_id, scan_id, method_id, 'p0' AS parameter_name, node_id FROM f_nodes WHERE q % 11 = 0",
    "f_returns": "SELECT project_id, scan_id, method_id, node_id, l_partkey % 97 = 0 AS may_return_tainted FROM f_nodes WHERE kind = 'ReturnStatement' OR l_partkey % 97 = 0",
    "f_cfg": """
SELECT l_orderkey, project_id, scan_id, method_id, CAST(pos AS INT) AS src, CAST(pos + 1 AS INT) AS dst, 'sequential' AS edge_kind FROM f_nodes
UNION ALL SELECT l_orderkey, project_id, scan_id, method_id, CAST(pos AS INT), CAST(pos + 2 AS INT), 'true_branch' FROM f_nodes WHERE l_returnflag = 'R'
UNION ALL SELECT l_orderkey, project_id, scan_id, method_id, CAST(pos AS INT), CAST(pos - 1 AS INT), 'exception' FROM f_nodes WHERE q > 45 AND pos > 1""",
    "f_size": "SELECT project_id, scan_id, method_id, max(pos) AS n FROM f_nodes GROUP BY project_id, scan_id, method_id",
    "f_edges": """
SELECT e.project_id, e.scan_id, e.method_id, e.src, e.dst, e.edge_kind FROM f_cfg e
JOIN f_size s ON s.project_id = e.project_id AND s.scan_id = e.scan_id AND s.method_id = e.method_id WHERE e.dst <= s.n""",
    "f_notes": """
SELECT project_id, scan_id, class_id AS target_id, 'class' AS target_kind, 'AuthorizeAttribute' AS attribute_name, '' AS args FROM f_classes WHERE attrs LIKE 'Authorize%'
UNION ALL SELECT project_id, scan_id, class_id, 'class', 'ApiControllerAttribute', '' FROM f_classes WHERE attrs LIKE 'ApiController%'
UNION ALL SELECT project_id, scan_id, method_id, 'method', 'HttpPostAttribute', '' FROM f_methods WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT project_id, scan_id, method_id, 'method', 'HttpGetAttribute', '' FROM f_methods WHERE o_orderpriority = '2-HIGH'
UNION ALL SELECT project_id, scan_id, method_id, 'method', 'HttpPutAttribute', '' FROM f_methods WHERE o_orderpriority = '3-MEDIUM'
UNION ALL SELECT project_id, scan_id, method_id, 'method', 'ValidateAntiForgeryTokenAttribute', '' FROM f_methods WHERE o_orderpriority = '3-MEDIUM' AND o_custkey % 2 = 0
UNION ALL SELECT project_id, scan_id, method_id, 'method', 'AllowAnonymousAttribute', '' FROM f_methods WHERE o_orderpriority = '4-NOT SPECIFIED'
UNION ALL SELECT project_id, scan_id, method_id, 'method', 'RouteAttribute', CASE WHEN o_custkey % 3 = 0 THEN 'api/Admin/list' ELSE 'home' END FROM f_methods WHERE o_orderpriority = '4-NOT SPECIFIED'
UNION ALL SELECT project_id, scan_id, method_id, 'method', 'ValidateInputAttribute', CASE WHEN o_custkey % 2 = 0 THEN 'False' ELSE 'true' END FROM f_methods WHERE o_orderkey % 37 = 0
UNION ALL SELECT project_id, scan_id, method_id, 'method', 'AllowHtmlAttribute', '' FROM f_methods WHERE o_orderkey % 41 = 0""",
}

STEPS = {
    "ev": "SELECT event_id, user_id * 100 + CAST(floor((CAST(day(ts) AS INT) - 1) / 5) AS INT) AS method_id, ts, event_type, value, props FROM events",
}
_EV_NUMBERED = "evn AS (SELECT *, row_number() OVER (PARTITION BY method_id ORDER BY ts, event_id) AS line FROM ev)"
STEP_NODES = """
SELECT method_id, event_id AS node_id, CAST(line AS INT) AS line, event_type AS kind, event_type = 'signup' AS is_source,
  event_type = 'purchase' AS is_sink, event_type = 'error' AS is_sanitizer, value, props FROM evn"""
STEP_EDGES = """
SELECT a.method_id, a.node_id AS src, b.node_id AS dst, 'flows_to' AS edge_kind, false AS is_conditional
FROM s_nodes a JOIN s_nodes b ON a.method_id = b.method_id AND b.line = a.line + 1
UNION ALL
SELECT a.method_id, a.node_id, b.node_id, 'aliases', a.value < 10
FROM s_kinds a JOIN s_kinds b ON a.method_id = b.method_id AND a.kind = b.kind AND b.nth = a.nth + 1"""


def _roles_sql(names: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with(full_symbol, '{n}')" for n in names) + ")"


# The checker's form of the role flags.
ROLE_SQL = (
    f"SELECT *, coalesce({_roles_sql(ROLE_SINKS)} AND NOT {_roles_sql(ROLE_SANITIZERS)}, false) AS is_sink, "
    f"coalesce({_roles_sql(ROLE_SOURCES)}, false) AS is_source, coalesce({_roles_sql(ROLE_SANITIZERS)}, false) AS is_san FROM f_nodes"
)


def fact_ctes(*extra: str) -> str:
    """`WITH` text of all flat facts for the checker; `f_role` adds the role flags."""
    parts = [_LI.strip()] + [f"{n} AS ({q.strip()})" for n, q in FACTS.items()] + [f"f_role AS ({ROLE_SQL})", *extra]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def step_ctes(*extra: str) -> str:
    parts = [f"{n} AS ({q})" for n, q in STEPS.items()] + [
        _EV_NUMBERED, f"s_nodes AS ({STEP_NODES.strip()})",
        "s_kinds AS (SELECT *, row_number() OVER (PARTITION BY method_id, kind ORDER BY line) AS nth FROM s_nodes)",
        f"s_edges AS ({STEP_EDGES.strip()})", *extra]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# --- Spark side -------------------------------------------------------------------------


_memo: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A numbered base table, written once per session and folder and read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _memo:
        _memo[key] = make()
    return _memo[key]


class Lazy(Mapping):
    """Frames by name, each made when it is first asked for, so a query stages only what it reads."""

    def __init__(self, makers: dict):
        self.makers, self.made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __iter__(self):
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def run_sql(spark: SparkSession, sf_dir: str, sql: str, views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Plain SQL whose table names in braces are given frames or files of the folder."""
    names = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in sql}
    return spark.sql(sql, **names, **{n: views[n] for n in views or {} if "{" + n + "}" in sql})


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns the facts use, numbered by order; lazy, as only the written nodes read it."""
    used = table(spark, sf_dir, "lineitem").select(*dict.fromkeys(["l_orderkey", *LINE_ORDER, "l_discount", "l_tax", "l_returnflag", "l_linestatus"]))
    return staged(spark, sf_dir, "li", lambda: ranked_by_key(used, ["l_orderkey"], LINE_ORDER, "pos"))


def _braced(sql: str, names: list[str]) -> str:
    import re

    return re.sub(r"\b(FROM|JOIN) (" + "|".join(names) + r")\b", lambda m: f"{m[1]} {{{m[2]}}}", sql)


def flat(spark: SparkSession, sf_dir: str, *wanted: str) -> Mapping[str, DataFrame]:
    """The flat facts as lazy frames."""
    key = (spark.sparkContext.applicationId, sf_dir, "flat")
    if key not in _memo:
        makers = {"li": lambda: lines(spark, sf_dir)}
        made = _memo[key] = Lazy(makers)
        known = ["li", *FACTS, *TABLES]
        for name, sql in FACTS.items():
            make = lambda sql=sql: run_sql(spark, sf_dir, _braced(sql, known), made)
            makers[name] = (lambda make=make: staged(spark, sf_dir, "f_nodes", lambda: checkpoint(make()))) if name == "f_nodes" else make
    return {n: _memo[key][n] for n in wanted} if wanted else _memo[key]


def _list(column: str):
    return F.filter(F.split(column, ","), lambda x: x != "")


def facts(spark: SparkSession, sf_dir: str, roles: bool = True) -> Mapping[str, DataFrame]:
    """The typed fact tables over the flat facts, each made when it is asked for."""
    f = flat(spark, sf_dir)
    none = F.lit(None).cast("string")
    arg0 = F.struct(
        F.lit(0).alias("position"), F.col("a0_text").alias("text"), none.alias("resolved_type"), F.col("a0_lit").alias("is_literal"),
        F.col("a0_origin").alias("data_flow_origin"), F.col("a0_param").alias("origin_parameter_name"),
        F.col("a0_node").alias("origin_node_id"), none.alias("named_parameter"))
    arg1 = F.struct(
        F.lit(1).alias("position"), F.lit("p1").alias("text"), none.alias("resolved_type"), F.col("a1_lit").alias("is_literal"),
        F.lit("parameter").alias("data_flow_origin"), F.lit("p1").alias("origin_parameter_name"), none.alias("origin_node_id"),
        none.alias("named_parameter"))
    from taintgrid.functions.symbols import with_normalized_symbol

    def nodes() -> DataFrame:
        base = with_normalized_symbol(f["f_nodes"].select(
            "project_id", "scan_id", "ordinal", "node_id", "kind", "text", "file", "line", F.lit(0).alias("column"),
            F.col("symbol").alias("resolved_symbol"), none.alias("resolved_type"), F.col("method_id").alias("containing_method_id"),
            F.col("class_id").alias("containing_class_id"), F.slice(F.array(arg0, arg1), F.lit(1), F.col("nargs")).alias("arguments"),
            "is_async_call", F.col("is_in_try").alias("is_in_try_block"), F.expr("cast(array() as array<string>)").alias("parent_context"),
            F.col("pos").cast("int").alias("pos")))
        return staged(spark, sf_dir, "nodes", lambda: with_roles(base, load_roles(spark))) if roles else base

    keys = ["project_id", "scan_id"]
    by_node = lambda d: F.array(d)
    return Lazy({
        "nodes": nodes,
        "methods": lambda: f["f_methods"].select(
            *keys, "ordinal", "method_id", "name", F.concat("name", F.lit("()")).alias("signature"), "return_type", "is_async",
            F.lit(False).alias("is_static"), F.lit("public").alias("accessibility"), _list("attrs").alias("attributes"), "file",
            F.col("line_start").cast("int").alias("line_start"), (F.col("line_start") + 39).cast("int").alias("line_end"),
            "is_entry_point", F.col("class_id").alias("containing_class_id")),
        "classes": lambda: f["f_classes"].select(
            *keys, "ordinal", "class_id", "name", F.concat(F.lit("App."), "name").alias("full_name"), F.lit("class").alias("kind"),
            F.lit("").alias("file"), F.lit(1).alias("line"), "base_class", F.expr("cast(array() as array<string>)").alias("interfaces"),
            _list("attrs").alias("attributes"), F.lit(False).alias("is_abstract"), F.lit(False).alias("is_partial")),
        "parameters": lambda: f["f_params"].select(
            *keys, "method_id", "name", "resolved_type", "position", F.lit(False).alias("has_default"), _list("bindings").alias("binding_attributes")),
        "assignments": lambda: f["f_assign"].select(
            *keys, "ordinal", "assignment_id", "target_name", none.alias("target_type"), "source_node_id", "source_text", "is_literal",
            F.col("method_id").alias("containing_method_id"), "line"),
        "param_flows": lambda: f["f_used"].select(*keys, "method_id", "parameter_name", by_node("node_id").alias("used_in_node_ids"),
            F.expr("cast(array() as array<string>)").alias("assigned_to_ids")).unionByName(f["f_assigned"].select(
            *keys, "method_id", "parameter_name", F.expr("cast(array() as array<string>)").alias("used_in_node_ids"), by_node("node_id").alias("assigned_to_ids"))),
        "return_flows": lambda: f["f_returns"].select(*keys, "method_id", by_node("node_id").alias("returned_node_ids"), F.lit("string").alias("return_type"), "may_return_tainted"),
        "cfg_blocks": lambda: f["f_nodes"].select(
            *keys, "method_id", F.col("pos").cast("int").alias("block_no"), F.col("pos").cast("int").alias("block_id"), F.lit("basic").alias("kind"),
            by_node("node_id").alias("node_ids"), F.col("line").alias("line_start"), F.col("line").alias("line_end"), none.alias("branch_condition"),
            F.lit(False).alias("is_exception_handler"), (F.col("pos") == 1).alias("is_entry"), F.lit(False).alias("is_exit")),
        "cfg_edges": lambda: f["f_cfg"].select(*keys, "method_id", F.col("src").alias("from_block_id"), F.col("dst").alias("to_block_id"), "edge_kind"),
        "annotations": lambda: f["f_notes"].select(*keys, "target_id", "target_kind", "attribute_name", F.col("attribute_name").alias("resolved_attribute"), _list("args").alias("arguments")),
        "external_calls": lambda: f["f_nodes"].where("k % 3 = 1").select(*keys, "ordinal", "node_id", F.col("symbol").alias("resolved_symbol"), F.lit("lib").alias("assembly"), "line", "file"),
        "meta": lambda: table(spark, sf_dir, "customer").select(
            F.concat(F.lit("p"), (F.col("c_custkey") % 7).cast("string")).alias("project_id"), F.lit("s1").alias("scan_id"),
            F.col("c_custkey").alias("batch_no"), F.array(F.concat(F.lit("src/c"), F.col("c_custkey").cast("string"), F.lit(".cs"))).alias("files"),
            F.lit("Latest").alias("language_version"), none.alias("framework_detected"),
            F.when(F.col("c_custkey") % 7 == 1, F.array(F.lit("Dapper/2.1"), F.lit("Microsoft.AspNetCore.App/8.0")))
            .when(F.col("c_custkey") % 7 == 2, F.array(F.lit("EntityFramework/6.4"), F.lit("System.ServiceModel.Http/6.0")))
            .when(F.col("c_custkey") % 7 == 3, F.array(F.lit("Grpc.AspNetCore")))
            .otherwise(F.expr("cast(array() as array<string>)")).alias("nuget_references"),
            F.expr("cast(null as array<struct<file:string,line:int,message:string,severity:string>>)").alias("compilation_errors"),
            F.lit("2024-01-01T00:00:00").alias("analysis_timestamp"), F.lit("1").alias("bridge_version")),
    })


def steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the event walks."""
    def numbered() -> DataFrame:
        ev = run_sql(spark, sf_dir, _braced(STEPS["ev"], TABLES))
        evn = ranked(ev, ["method_id"], ["ts", "event_id"], "line")
        return ranked(run_sql(spark, sf_dir, _braced(STEP_NODES, ["evn"]), {"evn": evn}), ["method_id", "kind"], ["line"], "nth")

    kinds = staged(spark, sf_dir, "steps", numbered)
    edges = run_sql(spark, sf_dir, _braced(STEP_EDGES, ["s_nodes", "s_kinds"]), {"s_nodes": kinds.drop("nth"), "s_kinds": kinds})
    return kinds.drop("nth"), edges
