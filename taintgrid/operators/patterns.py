"""Pattern findings: sinks matched by symbol, with guards read from the method around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.operators.build import M, Facts, method_nodes, methods_with_class
from taintgrid.operators.prefix import match_pattern
from taintgrid.session import KEYS

# --- fixed values: id | symbol | kind | argument positions | cwe score ---------------------
# Every pattern reports at confidence high unless listed below.
PATTERNS = """
SQL-001 System.Data.SqlClient.SqlCommand..ctor SQL_INJECTION 0 CWE-89 9.8
SQL-002 Microsoft.Data.SqlClient.SqlCommand..ctor SQL_INJECTION 0 CWE-89 9.8
SQL-003 Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.FromSqlRaw SQL_INJECTION 1 CWE-89 9.8
SQL-004 Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.ExecuteSqlRaw SQL_INJECTION 1 CWE-89 9.8
SQL-005 Dapper.SqlMapper.Execute SQL_INJECTION 1 CWE-89 9.8
SQL-006 Dapper.SqlMapper.Query SQL_INJECTION 1 CWE-89 9.8
SQL-007 System.Data.OleDb.OleDbCommand SQL_INJECTION 0 CWE-89 9.8
CMD-001 System.Diagnostics.Process.Start COMMAND_INJECTION 0,1 CWE-78 9.8
CMD-002 System.Diagnostics.ProcessStartInfo..ctor COMMAND_INJECTION 0 CWE-78 9.8
PATH-001 System.IO.File.ReadAllText PATH_TRAVERSAL 0 CWE-22 7.5
PATH-002 System.IO.File.Open PATH_TRAVERSAL 0 CWE-22 7.5
PATH-003 System.IO.FileStream..ctor PATH_TRAVERSAL 0 CWE-22 7.5
DESER-001 System.Runtime.Serialization.Formatters.Binary.BinaryFormatter.Deserialize INSECURE_DESERIALIZATION always CWE-502 9.8
DESER-002 System.Web.Script.Serialization.JavaScriptSerializer.Deserialize INSECURE_DESERIALIZATION 0 CWE-502 8.1
DESER-003 Newtonsoft.Json.JsonConvert.DeserializeObject INSECURE_DESERIALIZATION 0 CWE-502 8.1
XXE-001 System.Xml.XmlDocument.Load XXE 0 CWE-611 7.5
XXE-001B System.Xml.Linq.XDocument.Load XXE 0 CWE-611 5.9
XXE-002 System.Xml.XmlDocument.LoadXml XXE 0 CWE-611 7.5
SSRF-001 System.Net.Http.HttpClient.GetAsync SSRF 0 CWE-918 8.6
SSRF-002 System.Net.Http.HttpClient.PostAsync SSRF 0 CWE-918 8.6
SSRF-003 System.Net.WebRequest.Create SSRF 0 CWE-918 8.6
REFLECT-001 System.Reflection.Assembly.Load REFLECTION_ABUSE 0 CWE-470 9.8
REFLECT-002 System.Activator.CreateInstance REFLECTION_ABUSE 0 CWE-470 8.1
REFLECT-003 System.Type.GetType REFLECTION_ABUSE 0 CWE-470 6.5
XSS-001 Microsoft.AspNetCore.Html.HtmlString..ctor RAZOR_XSS 0 CWE-79 6.1
XSS-002 Microsoft.AspNetCore.Mvc.Rendering.HtmlHelperExtensions.Raw RAZOR_XSS 0 CWE-79 6.1
"""
PATTERN_CONFIDENCE = {"DESER-001": "confirmed", "DESER-003": "medium", "XXE-001B": "medium", "REFLECT-003": "medium"}
ATTRIBUTE_PATTERNS = """
ATTR-001 ValidateInputAttribute XSS medium CWE-79
ATTR-002 AllowHtmlAttribute XSS low CWE-79
"""
# ------------------------------------------------------------------------------------------

PATTERN_COLUMNS = ["pattern_id", "vulnerability_kind", "positions", "always_vulnerable", "confidence", "cwe", "cvss_base"]


def load_patterns(spark: SparkSession) -> DataFrame:
    rows = []
    for i, line in enumerate(PATTERNS.strip().splitlines()):
        pid, symbol, kind, pos, cwe, score = line.split()
        always = pos == "always"
        rows.append((i, symbol, pid, kind, [0] if always else [int(p) for p in pos.split(",")], always, PATTERN_CONFIDENCE.get(pid, "high"), cwe, float(score)))
    return spark.createDataFrame(
        rows, "ordinal int, symbol string, pattern_id string, vulnerability_kind string, positions array<int>, always_vulnerable boolean, "
        "confidence string, cwe string, cvss_base double")


def catalog_patterns(rules: DataFrame) -> DataFrame:
    """Every sink rule as a pattern; a repeated symbol keeps its first place and its last values."""
    sinks = rules.where("rule_type = 'sink' and length(symbol) > 0")
    row = F.struct(
        F.coalesce("id", F.concat(F.lit("custom-"), C.short("symbol", 20))).alias("pattern_id"),
        F.coalesce("vulnerability", F.lit("UNKNOWN")).alias("vulnerability_kind"),
        F.coalesce("tainted_args", F.array(F.lit(0))).alias("positions"), F.coalesce("always_vulnerable", F.lit(False)).alias("always_vulnerable"),
        F.coalesce("confidence_level", F.lit("medium")).alias("confidence"), F.coalesce("cwe", F.lit("CWE-Unknown")).alias("cwe"),
        F.coalesce("cvss_base", F.lit(7.0)).alias("cvss_base"))
    per = sinks.groupBy("symbol").agg(F.max_by(row, "ordinal").alias("_r"), F.min("ordinal").alias("ordinal"))
    return per.select("symbol", "ordinal", "_r.*")


def _per_method(nodes: DataFrame, **flags: Column) -> DataFrame:
    return nodes.groupBy(*M).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()])


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def guards(nodes: DataFrame) -> DataFrame:
    """(M, command, path, host): which guards a method has, for methods with one; one aggregate for all three.

    command: the shell is switched off and arguments go as a list. path: the path is resolved and its start checked.
    host: the host is compared with a whitelist.
    """
    t, s = _low("text"), _low("resolved_symbol")
    host = t.contains(".host") & (t.contains("contains(") | t.contains("indexof(") | t.contains("array.indexof") | s.contains("contains"))
    flags = _per_method(
        nodes, shell=t.contains("useshellexecute") & t.contains("false"), args=s.contains("argumentlist") | t.contains("argumentlist"),
        name=s.contains("path.getfilename") | t.contains("getfilename"), full=s.contains("path.getfullpath") | t.contains("getfullpath"),
        start=t.contains("startswith"), met=host, hint=t.contains("whitelist") | t.contains("allowedhost"))
    return flags.select(
        *M, F.expr("shell and args").alias("command"), F.expr("(name and (full or start)) or (full and start)").alias("path"),
        F.expr("met and hint").alias("host")).where("command or path or host")


def command_guard(nodes: DataFrame) -> DataFrame:
    return guards(nodes).where("command").select(*M)


def path_guard(nodes: DataFrame) -> DataFrame:
    return guards(nodes).where("path").select(*M)


def host_guard(nodes: DataFrame) -> DataFrame:
    return guards(nodes).where("host").select(*M)


def adjusted_confidence() -> Column:
    return (
        F.when(F.col("is_in_try_block") & (F.col("confidence") == "confirmed"), "high")
        .when(C.has_tainted_args() & (F.col("confidence") == "high"), "confirmed")
        .otherwise(F.col("confidence"))
    )


def match_patterns(facts: Facts, patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """Pattern findings of all nodes. Guards apply to command, path and host sinks."""
    nodes = facts["nodes"].where("length(resolved_symbol) > 0")
    hit = match_pattern(nodes, patterns, catalog_patterns(rules), PATTERN_COLUMNS)
    open_arg = F.exists(
        "positions", lambda p: F.coalesce(~F.get(F.col("arguments"), p)["is_literal"], F.lit(False)))
    listed = F.size("positions") > 0
    loose = C.has_tainted_args() | (F.size("arguments") <= 0)
    hit = hit.where(F.col("always_vulnerable") | F.when(listed, open_arg).otherwise(loose))
    hit = hit.withColumnRenamed("containing_method_id", "method_id")
    sem = method_nodes(facts)
    guard = guards(sem).select(*M, F.col("command").alias("_command"), F.col("path").alias("_path"), F.col("host").alias("_host"))
    kind = F.col("vulnerability_kind")
    safe = ((kind == "COMMAND_INJECTION") & F.col("_command")) | ((kind == "PATH_TRAVERSAL") & F.col("_path")) | ((kind == "SSRF") & F.col("_host"))
    blocked = safe & ~F.col("always_vulnerable") & (F.size("positions") > 0)
    hit = hit.join(guard, M, "left").where(~F.coalesce(blocked, F.lit(False)))
    meth = methods_with_class(facts).select(*M, F.col("name").alias("method_name"), "class_name")
    return hit.join(meth, M, "left").select(
        *M, "node_id", "pattern_id", "vulnerability_kind", adjusted_confidence().alias("confidence"), "file", "line", "column",
        F.col("text").alias("code_snippet"), "resolved_symbol", "matched_prefix", "method_name", "class_name",
        C.has_tainted_args().alias("has_tainted_args"), F.transform(C.tainted_args(), lambda a: a["position"]).alias("tainted_positions"),
        "cwe", "cvss_base", "always_vulnerable")


def annotations(facts: Facts, annotations_only: bool = False) -> DataFrame:
    """Attribute rows (keys, target_id, target_kind, attribute_name, arguments). Attributes listed on
    classes and methods count too, unless annotations_only."""
    out = facts["annotations"].select(*KEYS, "target_id", "target_kind", "attribute_name", "arguments")
    if annotations_only:
        return out
    none = F.expr("cast(array() as array<string>)").alias("arguments")
    own = facts["classes"].select(*KEYS, F.col("class_id").alias("target_id"), F.lit("class").alias("target_kind"), F.explode("attributes").alias("attribute_name"), none)
    own = own.unionByName(facts["methods"].select(
        *KEYS, F.col("method_id").alias("target_id"), F.lit("method").alias("target_kind"), F.explode("attributes").alias("attribute_name"), none))
    return out.unionByName(own.join(out, [*KEYS, "target_id", "attribute_name"], "left_anti").dropDuplicates([*KEYS, "target_id", "attribute_name"]))


def match_attributes(facts: Facts, annotations_only: bool = True) -> DataFrame:
    """Dangerous attributes on methods and classes."""
    rows = [tuple(line.split()) for line in ATTRIBUTE_PATTERNS.strip().splitlines()]
    spark = facts["annotations"].sparkSession
    table = spark.createDataFrame(rows, "pattern_id string, attribute_name string, vulnerability_kind string, confidence string, cwe string")
    meth = methods_with_class(facts).select(
        *KEYS, F.col("method_id").alias("target_id"), F.col("name").alias("method_name"), "class_name", "file", F.col("line_start").alias("line"))
    return annotations(facts, annotations_only).join(table, "attribute_name").join(meth, [*KEYS, "target_id"], "left").select(
        *KEYS, F.when(F.col("target_kind") == "method", F.col("target_id")).alias("method_id"), "target_id", "pattern_id", "vulnerability_kind",
        "confidence", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"),
        F.concat(F.lit("["), "attribute_name", F.lit("]")).alias("code_snippet"), "attribute_name", "method_name", "class_name", "cwe")
