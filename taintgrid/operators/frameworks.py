"""Framework detection and framework rules, each a table query over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.operators.build import M, Facts, method_nodes, methods_with_class
from taintgrid.operators.lines import near_lines
from taintgrid.operators.patterns import _low, _per_method, annotations
from taintgrid.operators.prefix import contains_first, prefix_first
from taintgrid.session import KEYS, checkpoint, top_n
from taintgrid.sources.facts import match_packages

# --- fixed values -------------------------------------------------------------------------
PACKAGE_FRAMEWORKS = """
Microsoft.AspNetCore aspnetcore
System.Web.Mvc aspnet_mvc
System.ServiceModel wcf
System.Windows.Forms winforms
Microsoft.EntityFrameworkCore ef_core
EntityFramework ef6
Dapper dapper
Grpc.AspNetCore grpc
Google.Protobuf grpc
""".split()
NAMESPACE_FRAMEWORKS = """
Microsoft.AspNetCore.Mvc aspnetcore
Microsoft.AspNetCore.Http aspnetcore
Microsoft.AspNetCore.Routing aspnetcore
System.Web.Mvc aspnet_mvc
System.Web.Http aspnet_mvc
System.ServiceModel wcf
System.Windows.Forms winforms
Microsoft.EntityFrameworkCore ef_core
System.Data.Entity ef6
Dapper dapper
Microsoft.AspNetCore.SignalR signalr
Grpc.AspNetCore grpc
""".split()
CLASS_ATTRIBUTE_FRAMEWORKS = {
    "ApiControllerAttribute": "aspnetcore", "ControllerAttribute": "aspnetcore", "RouteAttribute": "aspnetcore",
    "ServiceContractAttribute": "wcf",
}
METHOD_ATTRIBUTE_FRAMEWORKS = {
    "HttpGetAttribute": "aspnetcore", "HttpPostAttribute": "aspnetcore", "HttpPutAttribute": "aspnetcore",
    "HttpDeleteAttribute": "aspnetcore", "HttpPatchAttribute": "aspnetcore", "OperationContractAttribute": "wcf",
    "WebMethodAttribute": "aspnet_mvc",
}
BASE_CLASS_FRAMEWORKS = """
Microsoft.AspNetCore.Mvc.Controller aspnetcore
System.Web.Mvc.Controller aspnet_mvc
System.Web.UI.Page aspnet_mvc
System.Windows.Forms.Form winforms
System.Windows.Forms.UserControl winforms
""".split()
ORM_FRAMEWORKS = [("Microsoft.EntityFrameworkCore", "ef_core"), ("System.Data.Entity", "ef6"), ("Dapper.", "dapper")]
METADATA_FRAMEWORKS = ["aspnetcore", "aspnet_mvc", "wcf", "winforms", "ef_core"]
PRIORITY = {
    "aspnetcore": 1, "aspnet_mvc": 2, "wcf": 3, "winforms": 4, "grpc": 5, "signalr": 6, "ef_core": 7, "ef6": 8, "dapper": 9,
    "console": 10, "generic": 99,
}
SOURCE_SETS = {
    "aspnetcore": ["aspnetcore_sources", "general_sources"], "aspnet_mvc": ["aspnet_mvc_sources", "general_sources"],
    "wcf": ["wcf_sources", "general_sources"], "winforms": ["winforms_sources", "general_sources"],
    "console": ["console_sources"], "generic": ["general_sources"],
}
SINK_SETS = {
    "aspnetcore": ["sql_sinks", "command_sinks", "path_sinks", "deserialization_sinks", "ssrf_sinks", "razor_sinks", "xml_sinks", "reflection_sinks"],
    "aspnet_mvc": ["sql_sinks", "command_sinks", "path_sinks", "deserialization_sinks", "ssrf_sinks"],
    "wcf": ["sql_sinks", "command_sinks", "deserialization_sinks"],
    "generic": ["sql_sinks", "command_sinks", "path_sinks", "deserialization_sinks", "xml_sinks"],
}
ALWAYS_SETS = [("source", "general_sources"), ("sink", "sql_sinks"), ("sink", "command_sinks"), ("sink", "path_sinks")]
NULLABLE_VERSIONS = ["CSharp9", "CSharp10", "CSharp11", "CSharp12", "Latest"]
MINIMAL_API = ["MapGet", "MapPost", "MapPut", "MapDelete", "MapPatch"]
FRAMEWORK_SOURCES = """
aspnetcore Microsoft.AspNetCore.Http.IQueryCollection USER_INPUT
aspnetcore Microsoft.AspNetCore.Http.IFormCollection USER_INPUT
aspnetcore Microsoft.AspNetCore.Http.IHeaderDictionary USER_INPUT
aspnetcore Microsoft.AspNetCore.Http.HttpRequest.Query USER_INPUT
aspnetcore Microsoft.AspNetCore.Http.HttpRequest.Form USER_INPUT
aspnetcore Microsoft.AspNetCore.Http.HttpRequest.Headers USER_INPUT
aspnetcore Microsoft.AspNetCore.Http.HttpRequest.Body USER_INPUT
aspnetcore Microsoft.AspNetCore.Http.HttpRequest.Path USER_INPUT
aspnetcore Microsoft.AspNetCore.Routing.RouteData USER_INPUT
aspnet_mvc System.Web.HttpRequest.QueryString USER_INPUT
aspnet_mvc System.Web.HttpRequest.Form USER_INPUT
aspnet_mvc System.Web.HttpRequest.Headers USER_INPUT
aspnet_mvc System.Web.HttpRequest.Cookies USER_INPUT
aspnet_mvc System.Web.HttpRequest.ServerVariables USER_INPUT
aspnet_mvc System.Web.HttpRequest.InputStream USER_INPUT
wcf System.ServiceModel.OperationContext USER_INPUT
wcf System.ServiceModel.Channels.Message USER_INPUT
winforms System.Windows.Forms.TextBox.Text USER_INPUT
winforms System.Windows.Forms.RichTextBox.Text USER_INPUT
winforms System.Windows.Forms.ComboBox.Text USER_INPUT
winforms System.Windows.Forms.DataGridView USER_INPUT
console System.Console.ReadLine USER_INPUT
console System.Console.In USER_INPUT
console System.Environment.GetCommandLineArgs USER_INPUT
* System.IO.StreamReader.ReadToEnd EXTERNAL_INPUT
* System.IO.StreamReader.ReadLine EXTERNAL_INPUT
* System.Net.WebClient.DownloadString EXTERNAL_INPUT
""".split()
FRAMEWORK_SINKS = """
aspnetcore Microsoft.AspNetCore.Html.HtmlString XSS
aspnetcore Microsoft.AspNetCore.Mvc.Rendering.HtmlHelperExtensions.Raw XSS
ef_core Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.FromSqlRaw SQL_INJECTION
ef_core Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.ExecuteSqlRaw SQL_INJECTION
ef_core Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.FromSqlInterpolated SQL_INJECTION
dapper Dapper.SqlMapper.Execute SQL_INJECTION
dapper Dapper.SqlMapper.Query SQL_INJECTION
dapper Dapper.SqlMapper.QueryAsync SQL_INJECTION
dapper Dapper.SqlMapper.ExecuteAsync SQL_INJECTION
""".split()
# symbol prefix, rule, kind, category, confidence, cwe, score
SYMBOL_RULES = """
System.Runtime.Serialization.Formatters.Binary.BinaryFormatter FW-DEPR-001 INSECURE_DESERIALIZATION deprecated_api confirmed CWE-502 9.8
System.Runtime.Serialization.Formatters.Soap.SoapFormatter FW-DEPR-002 INSECURE_DESERIALIZATION deprecated_api confirmed CWE-502 9.8
System.Runtime.Serialization.NetDataContractSerializer FW-DEPR-003 INSECURE_DESERIALIZATION deprecated_api high CWE-502 8.1
System.Security.Cryptography.MD5 FW-CRYPTO-001 UNKNOWN cryptography high CWE-327 7.5
System.Security.Cryptography.SHA1 FW-CRYPTO-002 UNKNOWN cryptography high CWE-327 5.9
System.Security.Cryptography.DESCryptoServiceProvider FW-CRYPTO-003 UNKNOWN cryptography high CWE-327 7.5
System.Security.Cryptography.TripleDES FW-CRYPTO-004 UNKNOWN cryptography high CWE-327 5.9
System.Security.Cryptography.RC2 FW-CRYPTO-005 UNKNOWN cryptography high CWE-327 7.5
"""
SECRET_NAMES = "(?i)(password|passwd|pwd|secret|apikey|api_key|token|connectionstring|connectionstr|connstr|privatekey|private_key|credentials|auth_key)"
PLACEHOLDERS = ["changeme", "password", "secret", "your-secret", "placeholder", "xxx", "***", "todo", "replace", "your-api-key", "", "none", "null"]
SECURITY_WORDS = "(?i)(token|nonce|salt|key|password|session|csrf|otp|captcha|secret)"
MUTATING = ["HttpPostAttribute", "HttpPutAttribute", "HttpDeleteAttribute", "HttpPatchAttribute"]
CSRF_GUARDS = ["ValidateAntiForgeryTokenAttribute", "IgnoreAntiforgeryTokenAttribute", "AutoValidateAntiforgeryToken"]
PRIVILEGED = ["admin", "manage", "internal", "private", "system"]
REDIRECTS = ["Microsoft.AspNetCore.Mvc.ControllerBase.Redirect", "Microsoft.AspNetCore.Mvc.Controller.Redirect", "Redirect"]
HTTP_READS = ["request.query", "request.form", "request.headers", "request.body", "request.bodyreader", "route["]
PLAIN_PARAMETERS = ["System.Threading.CancellationToken", "Microsoft.AspNetCore.Http.HttpContext"]
RAW_SQL = ["Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.FromSqlRaw", "Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.ExecuteSqlRaw"]
# rule -> frameworks that switch it on; rules not named here always run
GATES = {
    "FW-ASPNET-001": ["aspnetcore"], "FW-ASPNET-002": ["aspnetcore"], "FW-ASPNET-003": ["aspnetcore"], "FW-ASPNET-004": ["aspnetcore"],
    "FW-CORS-001": ["aspnetcore"], "FW-MVC-001": ["aspnet_mvc"], "FW-EF-001": ["ef_core", "ef6"], "FW-WCF-001": ["wcf"],
}
# ------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, words: list[str]) -> DataFrame:
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(words[::2], words[1::2]))]
    return spark.createDataFrame(rows, "ordinal int, symbol string, framework string")


def _map(spark: SparkSession, pairs: dict[str, str], name: str) -> DataFrame:
    return spark.createDataFrame(list(pairs.items()), f"{name} string, framework string")


# --- detection --------------------------------------------------------------------------


def framework_evidence(facts: Facts) -> DataFrame:
    """(keys, framework, step, confidence, version, n_evidence): the first evidence of each of the 7
    steps, as counts of distinct pieces; text evidence is in `framework_refs`."""
    spark = facts["nodes"].sparkSession
    cols = [*KEYS, "framework", "step", "confidence", "version", "evidence"]

    def part(df: DataFrame, step: int, level: str, evidence: Column, version: Column | None = None) -> DataFrame:
        return df.select(
            *KEYS, "framework", F.lit(step).alias("step"), F.lit(level).alias("confidence"),
            (F.lit(None) if version is None else version).cast("string").alias("version"), evidence.alias("evidence"))

    meta = facts["meta"].groupBy(*KEYS).agg(F.min_by("framework_detected", "batch_no").alias("fw"))
    meta = meta.withColumn("framework", F.lower("fw")).where(F.col("framework").isin(*METADATA_FRAMEWORKS))
    packages = match_packages(facts["meta"], _pairs(spark, PACKAGE_FRAMEWORKS))
    calls = facts["external_calls"].select(*KEYS, F.split("resolved_symbol", r"\.").alias("parts"))
    spaces = calls.select(*KEYS, F.explode(F.array_compact(F.array(
        F.when(F.size("parts") >= 2, F.array_join(F.slice("parts", 1, 2), ".")),
        F.when(F.size("parts") >= 3, F.array_join(F.slice("parts", 1, 3), "."))))).alias("namespace")).distinct()
    # every framework whose namespace starts one in use counts, not only the first
    from taintgrid.operators.prefix import prefix_matches

    hits = prefix_matches(spaces, _pairs(spark, NAMESPACE_FRAMEWORKS), "namespace")
    spaces = spaces.join(hits.select(F.col("_symbol").alias("namespace"), "framework").distinct(), "namespace")
    class_attrs = facts["classes"].select(*KEYS, F.explode("attributes").alias("attribute")).distinct().join(
        _map(spark, CLASS_ATTRIBUTE_FRAMEWORKS, "attribute"), "attribute")
    bases = contains_first(
        facts["classes"].where("length(base_class) > 0").select(*KEYS, "base_class").distinct(), _pairs(spark, BASE_CLASS_FRAMEWORKS), ["framework"],
        "base_class").where("framework is not null")
    method_attrs = facts["methods"].select(*KEYS, F.explode("attributes").alias("attribute")).distinct().join(
        _map(spark, METHOD_ATTRIBUTE_FRAMEWORKS, "attribute"), "attribute")
    orm = F.coalesce(*[F.when(F.col("resolved_symbol").contains(text), fw) for text, fw in ORM_FRAMEWORKS])
    # the first node, in order, that names any of the three decides alone
    orms = facts["nodes"].where("resolved_symbol is not null").select(*KEYS, "ordinal", "resolved_symbol", orm.alias("framework")).where(
        "framework is not null").groupBy(*KEYS).agg(F.min_by(F.struct("framework", "resolved_symbol"), "ordinal").alias("o")).select(*KEYS, "o.*")
    found = (
        part(meta, 1, "high", F.col("fw"))
        .unionByName(part(packages, 2, "high", F.col("ref"), F.col("version")))
        .unionByName(part(spaces, 3, "medium", F.col("namespace")))
        .unionByName(part(class_attrs, 4, "high", F.col("attribute")))
        .unionByName(part(bases, 5, "high", F.col("base_class")))
        .unionByName(part(method_attrs, 6, "high", F.col("attribute")))
        .unionByName(part(orms, 7, "high", F.col("resolved_symbol")))
    )
    return found.select(*cols)


def detect_frameworks(facts: Facts) -> DataFrame:
    """(keys, framework, step, confidence, version, n_evidence). The first step that shows a framework
    gives its confidence; package evidence adds up while it comes first or second. Scans without any
    get `console` (a Main method or console calls) or `generic`."""
    found = framework_evidence(facts)
    first = found.groupBy(*KEYS, "framework").agg(
        F.min_by(F.struct("step", "confidence"), "step").alias("_f"),
        F.min_by("version", F.when(F.col("step") == 2, F.col("evidence"))).alias("version"),
        F.countDistinct(F.when(F.col("step") == 2, F.col("evidence"))).alias("_packages"))
    known = first.select(
        *KEYS, "framework", "_f.step", "_f.confidence", F.when(F.col("_f.step") == 2, F.col("version")).alias("version"),
        (F.when(F.col("_f.step") == 2, F.lit(0)).otherwise(1) + F.when(F.col("_f.step") <= 2, F.col("_packages")).otherwise(0)).cast("long").alias("n_evidence"))
    scans = facts["methods"].select(*KEYS).union(facts["nodes"].select(*KEYS)).union(facts["meta"].select(*KEYS)).distinct()
    bare = scans.join(known.select(*KEYS).distinct(), KEYS, "left_anti")
    mains = facts["methods"].where("name in ('Main', 'EntryPoint')").select(*KEYS)
    consoles = facts["nodes"].where("startswith(resolved_symbol, 'System.Console.')").select(*KEYS)
    shell = mains.union(consoles).distinct().withColumn("_console", F.lit(True))
    fallback = bare.join(shell, KEYS, "left").select(
        *KEYS, F.when(F.col("_console"), "console").otherwise("generic").alias("framework"), F.lit(8).alias("step"),
        F.when(F.col("_console"), "medium").otherwise("low").alias("confidence"), F.lit(None).cast("string").alias("version"), F.lit(1).cast("long").alias("n_evidence"))
    return known.unionByName(fallback)


def _level(values: dict[str, int], col: str, default: int) -> Column:
    out = F.lit(default)
    for name, v in values.items():
        out = F.when(F.col(col) == name, v).otherwise(out)
    return out


def primary_framework(detected: DataFrame) -> DataFrame:
    """(keys, primary_framework): smallest priority, then best confidence."""
    order = F.struct(_level(PRIORITY, "framework", 50), C.confidence_rank(), F.col("framework"))
    return detected.groupBy(*KEYS).agg(F.min_by("framework", order).alias("primary_framework"))


def profile_flags(facts: Facts) -> DataFrame:
    """One row per scan of booleans: async endpoints, model binding, injection, minimal API, Razor, nullable."""
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    meth = facts["methods"].groupBy(*KEYS).agg(any_(F.col("is_async") & F.col("is_entry_point")).alias("has_async_endpoints"))
    bind = facts["parameters"].groupBy(*KEYS).agg(any_(C.is_http_bound()).alias("uses_model_binding"))
    ctors = methods_with_class(facts).where("name = class_name").select(*M)
    inject = facts["parameters"].join(ctors, M, "left_semi").groupBy(*KEYS).agg(
        any_(F.col("name").contains("I") | F.col("resolved_type").contains("Service")).alias("uses_injection"))
    maps = F.lit(False)
    for m in MINIMAL_API:
        maps = maps | F.col("resolved_symbol").contains(m)
    api = facts["external_calls"].groupBy(*KEYS).agg(any_(maps).alias("has_minimal_api"))
    razor = facts["classes"].groupBy(*KEYS).agg(any_(F.col("base_class").contains("PageModel")).alias("has_razor_pages"))
    lang = facts["meta"].groupBy(*KEYS).agg(F.min_by("language_version", "batch_no").alias("v")).select(
        *KEYS, (F.col("v").contains("CSharp8") | F.col("v").isin(*NULLABLE_VERSIONS)).alias("has_nullable_annotations"))
    out = meth
    for d in (bind, inject, api, razor, lang):
        out = out.join(d, KEYS, "full_outer")
    return out.na.fill(False)


def active_rule_sets(detected: DataFrame) -> DataFrame:
    """(keys, set_kind, rule_set): sets of all detected frameworks and the ones always on."""
    rows = [(fw, "source", s) for fw, sets in SOURCE_SETS.items() for s in sets] + [(fw, "sink", s) for fw, sets in SINK_SETS.items() for s in sets]
    spark = detected.sparkSession
    table = spark.createDataFrame(rows, "framework string, set_kind string, rule_set string")
    always = detected.select(*KEYS).distinct().select(*KEYS, F.explode(F.array(*[
        F.struct(F.lit(k).alias("set_kind"), F.lit(s).alias("rule_set")) for k, s in ALWAYS_SETS])).alias("a")).select(*KEYS, "a.*")
    return detected.select(*KEYS, "framework").join(table, "framework").select(*KEYS, "set_kind", "rule_set").union(always).distinct()


def framework_symbols(detected: DataFrame, which: str = "source") -> DataFrame:
    """(keys, symbol, value): source labels or sink kinds the detected frameworks add."""
    words = FRAMEWORK_SOURCES if which == "source" else FRAMEWORK_SINKS
    rows = list(zip(words[::3], words[1::3], words[2::3]))
    table = detected.sparkSession.createDataFrame(rows, "framework string, symbol string, value string")
    scans = detected.select(*KEYS, "framework").union(detected.select(*KEYS).distinct().select(*KEYS, F.lit("*")))
    return scans.join(table, "framework").select(*KEYS, "symbol", "value").distinct()


# --- rules ------------------------------------------------------------------------------

FINDING = [
    *M, "target_id", "rule_id", "vulnerability_kind", "category", "confidence", "file", "line", "code_snippet", "method_name", "class_name", "cwe",
    "cvss_base", "evidence"]


def _methods(facts: Facts) -> DataFrame:
    return methods_with_class(facts).select(*M, F.col("name").alias("method_name"), "class_name")


def _node_findings(hits: DataFrame, facts: Facts, rule: str, kind: str, category: str, level: str, cwe: str, score: float, evidence: Column) -> DataFrame:
    """Finding rows at nodes. `hits` has containing_method_id renamed to method_id."""
    return hits.join(_methods(facts), M, "left").select(
        *M, F.col("node_id").alias("target_id"), F.lit(rule).alias("rule_id"), F.lit(kind).alias("vulnerability_kind"), F.lit(category).alias("category"),
        F.lit(level).alias("confidence"), "file", "line", F.col("text").alias("code_snippet"), "method_name", "class_name",
        F.lit(cwe).alias("cwe"), F.lit(score).alias("cvss_base"), evidence.cast("string").alias("evidence"))


def _nodes(facts: Facts) -> DataFrame:
    return facts["nodes"].withColumnRenamed("containing_method_id", "method_id")


def rule_symbols(facts: Facts, families: tuple[str, ...] = ("FW-DEPR", "FW-CRYPTO")) -> DataFrame:
    """Deprecated APIs and weak cryptography: first matching prefix of each family."""
    rows = []
    for i, line in enumerate(SYMBOL_RULES.strip().splitlines()):
        symbol, rule, kind, category, level, cwe, score = line.split()
        if rule.startswith(families):
            rows.append((i, symbol, rule, kind, category, level, cwe, float(score)))
    cols = ["rule_id", "vulnerability_kind", "category", "confidence", "cwe", "cvss_base"]
    table = facts["nodes"].sparkSession.createDataFrame(
        rows, "ordinal int, symbol string, rule_id string, vulnerability_kind string, category string, confidence string, cwe string, cvss_base double")
    hits = prefix_first(_nodes(facts), table, cols, how="inner")
    return hits.join(_methods(facts), M, "left").select(
        *M, F.col("node_id").alias("target_id"), "rule_id", "vulnerability_kind", "category", "confidence", "file", "line",
        F.col("text").alias("code_snippet"), "method_name", "class_name", "cwe", "cvss_base", F.col("resolved_symbol").alias("evidence"))


def rule_deprecated(facts: Facts) -> DataFrame:
    return rule_symbols(facts, ("FW-DEPR",))


def rule_weak_crypto(facts: Facts) -> DataFrame:
    return rule_symbols(facts, ("FW-CRYPTO",))


def rule_secrets(facts: Facts) -> DataFrame:
    """Literals assigned to names that read like secrets, placeholders excluded."""
    src = F.col("source_text")
    clean = F.lower(F.regexp_replace(src, "^[\"']+|[\"']+$", ""))
    hit = facts["assignments"].where(
        F.col("is_literal") & F.col("target_name").rlike(SECRET_NAMES) & (F.length(src) >= 6) & ~clean.isin(*PLACEHOLDERS) & (F.length(clean) >= 4))
    meth = methods_with_class(facts).select(*M, F.col("name").alias("method_name"), "class_name", "file")
    return hit.withColumnRenamed("containing_method_id", "method_id").join(meth, M, "left").select(
        *M, F.col("assignment_id").alias("target_id"), F.lit("FW-SECRET-001").alias("rule_id"), F.lit("UNKNOWN").alias("vulnerability_kind"),
        F.lit("secrets").alias("category"), F.lit("medium").alias("confidence"), F.coalesce("file", F.lit("")).alias("file"), "line",
        F.concat(F.col("target_name"), F.lit(" = "), "source_text").alias("code_snippet"), "method_name", "class_name",
        F.lit("CWE-798").alias("cwe"), F.lit(7.5).alias("cvss_base"), F.col("target_name").alias("evidence"))


def rule_insecure_random(facts: Facts) -> DataFrame:
    """System.Random where the method name or the text speaks of security."""
    hits = method_nodes(facts).where(F.col("resolved_symbol").startswith("System.Random"))
    named = facts["methods"].where(F.col("name").rlike(SECURITY_WORDS)).select(*M).withColumn("_named", F.lit(True))
    hits = hits.join(facts["methods"].select(*M), M, "left_semi").join(named, M, "left")
    hits = hits.where(F.col("_named") | F.col("text").rlike(SECURITY_WORDS)).drop("_named")
    return _node_findings(hits, facts, "FW-CRYPTO-006", "UNKNOWN", "cryptography", "medium", "CWE-338", 7.5, F.col("resolved_symbol"))


def _method_findings(hits: DataFrame, rule: str, kind: str, category: str, level: str, cwe: str, score: float, evidence: Column) -> DataFrame:
    return hits.select(
        *M, F.col("method_id").alias("target_id"), F.lit(rule).alias("rule_id"), F.lit(kind).alias("vulnerability_kind"), F.lit(category).alias("category"),
        F.lit(level).alias("confidence"), "file", F.col("line_start").alias("line"), F.col("signature").alias("code_snippet"),
        F.col("name").alias("method_name"), "class_name", F.lit(cwe).alias("cwe"), F.lit(score).alias("cvss_base"), evidence.cast("string").alias("evidence"))


def _controllers(facts: Facts) -> DataFrame:
    return facts["classes"].where(C.class_flags()["is_controller"]).select(*KEYS, "class_id", F.col("name").alias("class_name"))


def _controller_methods(facts: Facts) -> DataFrame:
    return facts["methods"].join(_controllers(facts).withColumnRenamed("class_id", "containing_class_id"), [*KEYS, "containing_class_id"])


def _noted(notes: DataFrame, names: list[str], as_column: str) -> DataFrame:
    return notes.where(F.col("attribute_name").isin(*names)).select(*KEYS, F.col("target_id").alias(as_column)).distinct()


def rule_csrf(facts: Facts, annotations_only: bool = False) -> DataFrame:
    """Controller methods that change state without a token check on method or class."""
    notes = annotations(facts, annotations_only)
    changing = notes.where(F.col("attribute_name").isin(*MUTATING)).groupBy(*KEYS, F.col("target_id").alias("method_id")).agg(F.min("attribute_name").alias("verb"))
    hits = (
        _controller_methods(facts).join(changing, M)
        .join(_noted(notes, CSRF_GUARDS, "method_id"), M, "left_anti")
        .join(_noted(notes, [*CSRF_GUARDS, "ApiControllerAttribute"], "containing_class_id"), [*KEYS, "containing_class_id"], "left_anti")
    )
    return _method_findings(hits, "FW-ASPNET-001", "CSRF", "csrf", "high", "CWE-352", 6.5, F.col("verb"))


def rule_anonymous_route(facts: Facts, annotations_only: bool = False) -> DataFrame:
    """Anonymous entry points on a privileged route of a class that otherwise asks for a login."""
    notes = annotations(facts, annotations_only)
    routes = notes.where("attribute_name = 'RouteAttribute'").select(*KEYS, F.col("target_id").alias("method_id"), F.lower(F.array_join("arguments", " ")).alias("route"))
    hot = F.lit(False)
    for word in PRIVILEGED:
        hot = hot | F.col("route").contains(word)
    privileged = routes.where(hot).groupBy(*M).agg(F.min("route").alias("route"))
    hits = (
        _controller_methods(facts).where("is_entry_point")
        .join(_noted(notes, ["AllowAnonymousAttribute"], "method_id"), M, "left_semi")
        .join(_noted(notes, ["AuthorizeAttribute"], "containing_class_id"), [*KEYS, "containing_class_id"], "left_semi")
        .join(privileged, M)
    )
    return _method_findings(hits, "FW-ASPNET-002", "UNKNOWN", "authorization", "medium", "CWE-284", 5.3, F.col("route"))


def rule_model_validation(facts: Facts, annotations_only: bool = False) -> DataFrame:
    """Entry points of plain controllers that take a model and never look at its validity."""
    notes = annotations(facts, annotations_only)
    bound = facts["parameters"].where(C.is_user_controlled() & ~F.col("resolved_type").isin(*PLAIN_PARAMETERS)).select(*M).distinct()
    typ = F.col("resolved_type")
    models = facts["parameters"].where(typ.contains(".") & ~typ.contains("System.") & ~typ.contains("Microsoft.")).groupBy(*M).agg(F.min("name").alias("model"))
    checked = method_nodes(facts).where(F.col("text").contains("ModelState") | F.col("text").contains("IsValid")).select(*M).distinct()
    hits = (
        _controller_methods(facts).where("is_entry_point")
        .join(_noted(notes, ["ApiControllerAttribute"], "containing_class_id"), [*KEYS, "containing_class_id"], "left_anti")
        .join(bound, M, "left_semi").join(checked, M, "left_anti").join(models, M)
    )
    return _method_findings(hits, "FW-ASPNET-003", "UNKNOWN", "configuration", "low", "CWE-20", 4.3, F.col("model"))


def rule_cors(facts: Facts) -> DataFrame:
    """Any origin together with credentials somewhere in the scan; reported at the last any-origin node."""
    nodes = _nodes(facts)
    origin = nodes.where(F.col("text").contains("AllowAnyOrigin"))
    last = origin.groupBy(*KEYS).agg(F.max("ordinal").alias("ordinal"))
    both = nodes.where(F.col("text").contains("AllowCredentials")).select(*KEYS).distinct()
    hits = origin.join(last, [*KEYS, "ordinal"], "left_semi").join(both, KEYS, "left_semi")
    return _node_findings(hits, facts, "FW-CORS-001", "UNKNOWN", "cors", "high", "CWE-942", 7.4, F.lit("AllowAnyOrigin+AllowCredentials"))


def rule_open_redirect(facts: Facts) -> DataFrame:
    """Redirects to a computed target in methods that read HTTP input and never check for a local URL."""
    s, t = F.col("resolved_symbol"), F.col("text")
    named = F.lit(False)
    for r in REDIRECTS:
        named = named | (s == r) | s.endswith(f".{r}") | s.startswith(r)
    hits = method_nodes(facts).where(named & ~t.contains("LocalRedirect") & (F.size("arguments") > 0) & ~C.first_arg_is_literal())
    low, sym = _low("text"), _low("resolved_symbol")
    reads = F.lit(False)
    for w in HTTP_READS:
        reads = reads | low.contains(w)
    safe = low.contains("localredirect") | sym.contains("localredirect") | low.contains("islocalurl") | sym.contains("islocalurl")
    ok = _per_method(method_nodes(facts), reads=reads, safe=safe).where("reads and not safe").select(*M)
    return _node_findings(
        hits.join(ok, M, "left_semi"), facts, "FW-ASPNET-004", "OPEN_REDIRECT", "configuration", "high", "CWE-601", 6.1, F.get(F.col("arguments"), F.lit(0))["text"])


def rule_validate_input(facts: Facts) -> DataFrame:
    """Request validation switched off by attribute."""
    off = facts["annotations"].where(
        (F.col("attribute_name") == "ValidateInputAttribute") & F.exists("arguments", lambda a: F.lower(a).contains("false")))
    meth = methods_with_class(facts).select(*M, F.col("name").alias("method_name"), "class_name", "file", "line_start")
    return off.withColumn("method_id", F.col("target_id")).join(meth, M, "left").select(
        *M, "target_id", F.lit("FW-MVC-001").alias("rule_id"), F.lit("XSS").alias("vulnerability_kind"), F.lit("configuration").alias("category"),
        F.lit("high").alias("confidence"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line_start", F.lit(0)).alias("line"),
        F.lit("[ValidateInput(false)]").alias("code_snippet"), "method_name", "class_name", F.lit("CWE-79").alias("cwe"), F.lit(6.1).alias("cvss_base"),
        F.array_join("arguments", ",").alias("evidence"))


def rule_raw_sql(facts: Facts) -> DataFrame:
    """Raw SQL calls whose text is interpolated or concatenated."""
    s, t = F.col("resolved_symbol"), F.col("text")
    built = t.contains('$"') | t.contains("string.Format") | t.contains("+")
    hits = _nodes(facts).where((s.startswith(RAW_SQL[0]) | s.startswith(RAW_SQL[1])) & C.has_tainted_args() & built)
    return _node_findings(hits, facts, "FW-EF-001", "SQL_INJECTION", "injection", "high", "CWE-89", 9.8, C.last_segment("resolved_symbol"))


def rule_binding(facts: Facts) -> DataFrame:
    """Basic HTTP bindings with security mode None at most 10 lines away in the same file."""
    nodes = _nodes(facts)
    hits = nodes.where(F.col("resolved_symbol").contains("System.ServiceModel.BasicHttpBinding"))
    off = nodes.where(F.col("text").contains("Security.Mode") & F.col("text").contains("None")).select(*KEYS, "file", F.col("line").alias("line_b")).distinct()
    close = near_lines(hits.select(*KEYS, "node_id", "file", F.col("line").alias("line_a")), off, 10, [*KEYS, "file"]).select(*KEYS, "node_id").distinct()
    return _node_findings(
        hits.join(close, [*KEYS, "node_id"], "left_semi"), facts, "FW-WCF-001", "UNKNOWN", "transport_security", "high", "CWE-319", 7.5, F.lit("Security.Mode=None"))


RULE_FUNCTIONS = {
    "deprecated": rule_deprecated, "weak_crypto": rule_weak_crypto, "secrets": rule_secrets, "insecure_random": rule_insecure_random, "csrf": rule_csrf,
    "anonymous_route": rule_anonymous_route, "model_validation": rule_model_validation, "cors": rule_cors, "open_redirect": rule_open_redirect,
    "validate_input": rule_validate_input, "raw_sql": rule_raw_sql, "binding": rule_binding,
}


def gate_rules(findings: DataFrame, detected: DataFrame) -> DataFrame:
    """Drop findings of rules whose frameworks the scan does not use."""
    spark = findings.sparkSession
    gates = spark.createDataFrame([(r, fw) for r, fws in GATES.items() for fw in fws], "rule_id string, framework string")
    on = detected.select(*KEYS, "framework").join(gates, "framework").select(*KEYS, "rule_id").distinct()
    free = findings.where(~F.col("rule_id").isin(*GATES))
    return free.unionByName(findings.where(F.col("rule_id").isin(*GATES)).join(on, [*KEYS, "rule_id"], "left_semi").select(*findings.columns))


def framework_findings(facts: Facts, detected: DataFrame | None = None) -> DataFrame:
    """All framework findings, gated by the frameworks of each scan, with the primary framework."""
    detected = checkpoint(detect_frameworks(facts)) if detected is None else detected
    out = None
    for rule in RULE_FUNCTIONS.values():
        part = rule(facts).select(*FINDING)
        out = part if out is None else out.unionByName(part)
    return gate_rules(out, detected).join(primary_framework(detected), KEYS, "left")


def framework_refs(facts: Facts, n: int = 20) -> DataFrame:
    """The first n evidence texts per (scan, framework), for display."""
    return top_n(framework_evidence(facts), [*KEYS, "framework"], [F.col("step"), F.col("evidence")], n)
