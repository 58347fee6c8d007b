"""Findings to classified vulnerabilities: union, scores, ids, dedupe, consolidation, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.operators.build import M, Facts
from taintgrid.session import KEYS, checkpoint, ranked, top_n

# --- fixed values: kind, CWE, CVSS vector, score; addresses by CWE -----------------------
KINDS = [
    ("SQL_INJECTION", "CWE-89", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8),
    ("COMMAND_INJECTION", "CWE-78", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0),
    ("PATH_TRAVERSAL", "CWE-22", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N", 7.5),
    ("XXE", "CWE-611", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:L/A:N", 7.5),
    ("INSECURE_DESERIALIZATION", "CWE-502", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8),
    ("SSRF", "CWE-918", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:L/A:N", 8.6),
    ("REFLECTION_ABUSE", "CWE-470", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8),
    ("RAZOR_XSS", "CWE-79", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1),
    ("XSS", "CWE-79", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1),
    ("LOG_INJECTION", "CWE-117", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:L/A:N", 5.3),
    ("OPEN_REDIRECT", "CWE-601", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:L/A:N", 6.1),
    ("UNKNOWN", "CWE-693", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:L/A:N", 5.3),
    ("CSRF", "CWE-352", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:L/I:L/A:N", 6.5),
]
REFERENCES = {
    "CWE-89": [
        "https://owasp.org/www-community/attacks/SQL_Injection",
        "https://cheatsheetseries.owasp.org/cheatsheets/SQL_Injection_Prevention_Cheat_Sheet.html",
    ],
    "CWE-78": [
        "https://owasp.org/www-community/attacks/Command_Injection",
        "https://cheatsheetseries.owasp.org/cheatsheets/OS_Command_Injection_Defense_Cheat_Sheet.html",
    ],
    "CWE-22": [
        "https://owasp.org/www-community/attacks/Path_Traversal",
        "https://cheatsheetseries.owasp.org/cheatsheets/File_Upload_Cheat_Sheet.html",
    ],
    "CWE-611": [
        "https://owasp.org/www-community/vulnerabilities/XML_External_Entity_(XXE)_Processing",
        "https://cheatsheetseries.owasp.org/cheatsheets/XML_External_Entity_Prevention_Cheat_Sheet.html",
    ],
    "CWE-502": [
        "https://owasp.org/www-community/vulnerabilities/Deserialization_of_untrusted_data",
        "https://cheatsheetseries.owasp.org/cheatsheets/Deserialization_Cheat_Sheet.html",
    ],
    "CWE-918": [
        "https://owasp.org/www-community/attacks/Server_Side_Request_Forgery",
        "https://cheatsheetseries.owasp.org/cheatsheets/Server_Side_Request_Forgery_Prevention_Cheat_Sheet.html",
    ],
    "CWE-79": [
        "https://owasp.org/www-community/attacks/xss/",
        "https://cheatsheetseries.owasp.org/cheatsheets/Cross_Site_Scripting_Prevention_Cheat_Sheet.html",
    ],
    "CWE-601": [
        "https://cheatsheetseries.owasp.org/cheatsheets/Unvalidated_Redirects_and_Forwards_Cheat_Sheet.html",
    ],
    "CWE-352": [
        "https://cheatsheetseries.owasp.org/cheatsheets/Cross-Site_Request_Forgery_Prevention_Cheat_Sheet.html",
    ],
}
SINK_FIRST = [
    "readalltext", "readallbytes", "readalllines", "filestream", "openread", "openwrite", "writealltext", "writeallbytes", "appendalltext",
    "appendalllines", "copyto", "getfiles", "ziparchive",
]
ADVICE = {
    "SQL_INJECTION": "Use parameterised queries; never build SQL from input.",
    "COMMAND_INJECTION": "Keep the program name fixed and pass arguments as a list.",
    "PATH_TRAVERSAL": "Resolve the full path and check that it stays below the base folder.",
    "INSECURE_DESERIALIZATION": "Use a serializer bound to known types.",
    "XXE": "Prohibit DTD processing and clear the XML resolver.",
    "SSRF": "Allow only listed hosts and block private addresses.",
    "RAZOR_XSS": "Do not emit raw HTML from input; sanitise it first.",
    "CSRF": "Check an anti-forgery token on every request that changes state.",
}
OTHER_ADVICE = "Validate and sanitise all input before use and apply least privilege."
# ------------------------------------------------------------------------------------------


def load_kinds(spark: SparkSession) -> DataFrame:
    """(vulnerability_kind, kind_cwe, vector, kind_score, title, advice): 13 rows."""
    rows = []
    for kind, cwe, vector, score in KINDS:
        rows.append((kind, cwe, vector, score, kind.replace("_", " ").capitalize(), ADVICE.get(kind, OTHER_ADVICE)))
    return spark.createDataFrame(rows, "vulnerability_kind string, kind_cwe string, vector string, kind_score double, title string, advice string")


def references(cwe: Column) -> Column:
    """Reading list of a CWE."""
    out = F.expr("cast(array() as array<string>)")
    for name, links in REFERENCES.items():
        out = F.when(cwe == name, F.array(*[F.lit(x) for x in links])).otherwise(out)
    return out


VULN = [
    *KEYS, "finding_source", "vulnerability_kind", "severity", "confidence", "cwe", "vector", "cvss_score", "file", "line", "sink_line", "code_snippet",
    "method_id", "method_name", "class_name", "title", "description", "remediation", "source_label", "sink_label", "taint_label", "source_file",
    "is_in_loop", "has_partial_sanitizer", "is_entry_point", "vuln_id", "finding_id",
]


def taint_score(kind_score: Column, in_loop: Column, reachable: Column) -> Column:
    up = F.when(in_loop, F.least(F.lit(10.0), kind_score + 0.5)).otherwise(kind_score)
    return F.round(F.when(~reachable, F.greatest(F.lit(0.0), up - 0.5)).otherwise(up), 1)


def _row_id(source: str, *cols: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*KEYS, *cols)]
    return F.concat(F.lit(f"{source}-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def _with_kind(findings: DataFrame, kinds: DataFrame) -> DataFrame:
    """Findings with the columns of their kind; of a kind that is not listed, those of UNKNOWN."""
    listed = F.broadcast(kinds.withColumnRenamed("vulnerability_kind", "_kind"))
    known = F.col("vulnerability_kind").isin([k[0] for k in KINDS])
    named = findings.withColumn("_use", F.when(known, F.col("vulnerability_kind")).otherwise("UNKNOWN"))
    return named.join(listed, F.col("_use") == F.col("_kind")).drop("_use", "_kind")


def classify(facts: Facts, taint: DataFrame, patterns: DataFrame, framework: DataFrame) -> DataFrame:
    """The three kinds of findings in one shape, scored and with a stable id."""
    kinds = load_kinds(taint.sparkSession)
    none = lambda n: F.lit(None).cast("string").alias(n)
    no = lambda n: F.lit(False).alias(n)
    snippet = facts["nodes"].select(*KEYS, F.concat(F.lit("n:"), "node_id").alias("sink_node_id"), F.col("text").alias("code_snippet"))
    where = F.concat(C.basename("source_file"), F.lit(":"), F.col("source_line"), F.lit(" -> "), C.basename("sink_file"), F.lit(":"), F.col("sink_line"))
    t = taint.join(snippet, [*KEYS, "sink_node_id"], "left").transform(lambda d: _with_kind(d, kinds)).withColumn(
        "cvss_score", taint_score(F.col("kind_score"), F.col("is_in_loop"), F.col("is_definitely_reachable")))
    t = t.select(
        *KEYS, F.lit("taint").alias("finding_source"), "vulnerability_kind", C.severity("cvss_score").alias("severity"), "confidence",
        F.col("kind_cwe").alias("cwe"), "vector", "cvss_score", F.col("sink_file").alias("file"), F.col("source_line").alias("line"), "sink_line",
        F.coalesce("code_snippet", F.lit("")).alias("code_snippet"), "method_id", "method_name", "class_name", "title",
        F.concat_ws("\n", F.concat(F.lit("Tainted data flows from `"), "source_label", F.lit("` to `"), "sink_label", F.lit("`.")), where,
                    F.concat(F.lit("Method: "), "class_name", F.lit("."), "method_name", F.lit("()")),
                    F.when(F.col("has_partial_sanitizer"), F.concat(F.lit("A sanitizer covers some paths only: "), C.last_segment("sanitizer_symbol"))),
                    F.when(F.col("is_in_loop"), "The sink runs in a loop.")).alias("description"),
        F.col("advice").alias("remediation"), "source_label", "sink_label", "taint_label", "source_file", "is_in_loop", "has_partial_sanitizer",
        C.stable_id("sink_file", "sink_line", "sink_symbol").alias("vuln_id"), _row_id("taint", "source_node_id", "sink_node_id").alias("finding_id"))
    p = _with_kind(patterns, kinds).withColumn("cvss_score", F.round(F.coalesce("cvss_base", F.lit(7.0)), 1)).select(
        *KEYS, F.lit("pattern").alias("finding_source"), "vulnerability_kind", C.severity("cvss_score").alias("severity"), "confidence",
        F.col("kind_cwe").alias("cwe"), "vector", "cvss_score", "file", "line", F.col("line").alias("sink_line"), "code_snippet", "method_id",
        "method_name", "class_name", "title",
        F.concat_ws("\n", F.concat(F.lit("Pattern "), "pattern_id", F.lit(" at "), C.basename("file"), F.lit(":"), "line"),
                    F.concat(F.lit("Symbol: "), F.coalesce("resolved_symbol", F.lit("N/A")))).alias("description"),
        F.col("advice").alias("remediation"), none("source_label"), F.col("code_snippet").alias("sink_label"), none("taint_label"),
        F.col("file").alias("source_file"), no("is_in_loop"), no("has_partial_sanitizer"), C.stable_id("file", "line", "resolved_symbol").alias("vuln_id"),
        _row_id("pattern", "node_id", "pattern_id").alias("finding_id"))
    f = _with_kind(framework, kinds).withColumn("cvss_score", F.round("cvss_base", 1)).select(
        *KEYS, F.lit("framework").alias("finding_source"), "vulnerability_kind", C.severity("cvss_base").alias("severity"), "confidence",
        F.coalesce("cwe", "kind_cwe").alias("cwe"), "vector", "cvss_score", "file", "line", F.col("line").alias("sink_line"), "code_snippet", "method_id",
        "method_name", "class_name", F.concat("title", F.lit(" ("), "rule_id", F.lit(")")).alias("title"),
        F.concat(F.lit("Rule "), "rule_id", F.lit(" at "), C.basename("file"), F.lit(":"), "line").alias("description"),
        F.col("advice").alias("remediation"), none("source_label"), F.lit("").alias("sink_label"), none("taint_label"), F.col("file").alias("source_file"),
        no("is_in_loop"), no("has_partial_sanitizer"), C.stable_id("file", "line", "rule_id").alias("vuln_id"),
        _row_id("framework", "target_id", "rule_id").alias("finding_id"))
    entry = facts["methods"].select(*M, "is_entry_point")
    every = t.unionByName(p).unionByName(f)
    return every.join(entry, M, "left").withColumn("is_entry_point", F.coalesce("is_entry_point", F.lit(False))).select(*VULN)


def _source_order() -> Column:
    return F.when(F.col("finding_source") == "taint", 0).when(F.col("finding_source") == "pattern", 1).otherwise(2)


def originals(vulns: DataFrame) -> DataFrame:
    """(keys, vuln_id, finding_id, finding_source): which findings stand behind an id. A link table and
    not an array, since one id may gather any number of copies."""
    return vulns.select(*KEYS, "vuln_id", "finding_id", "finding_source").distinct()


def _first(rows: DataFrame, keys: list[str], order: list[Column], **more: Column) -> DataFrame:
    """The first row of each group with further aggregates, in one aggregate and so one read of the rows."""
    rest = [c for c in rows.columns if c not in keys and c not in more]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first, *[c.alias(n) for n, c in more.items()]).select(*keys, "_first.*", *more)


def dedupe_id(vulns: DataFrame) -> DataFrame:
    """One row per id, the best confidence; ties go to taint, pattern, framework, then finding id. Adds
    n_originals."""
    order = [C.confidence_rank(), _source_order(), F.col("finding_id")]
    return _first(vulns, [*KEYS, "vuln_id"], order, n_originals=F.count(F.lit(1)))


def consolidate(vulns: DataFrame) -> DataFrame:
    """One row per (file, sink line, kind), the best confidence. A place seen by taint and pattern is
    `combined`, and high confidence there becomes confirmed. Originals add up."""
    group = [*KEYS, "file", "sink_line", "vulnerability_kind"]
    order = [C.confidence_rank(), _source_order(), F.col("vuln_id")]
    best = _first(
        vulns, group, order, n_originals=F.sum("n_originals"), _t=F.bool_or(F.col("finding_source") == "taint"),
        _p=F.bool_or(F.col("finding_source") == "pattern"))
    both = F.col("_t") & F.col("_p")
    return best.withColumn(
        "confidence", F.when(both & (F.col("confidence") == "high"), "confirmed").otherwise(F.col("confidence"))).withColumn(
        "finding_source", F.when(both, "combined").otherwise(F.col("finding_source"))).drop("_t", "_p")


def sink_priority() -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce("sink_label", F.lit("")), F.coalesce("code_snippet", F.lit(""))))
    first = F.lit(False)
    for word in SINK_FIRST:
        first = first | text.contains(word)
    return F.when(first, 0).when(text.contains("exists"), 1).when(text.contains("getfullpath") | text.contains("combine"), 2).otherwise(1)


def consolidate_flows(vulns: DataFrame) -> DataFrame:
    """Path-traversal findings of one flow (source file, class, label) become the best of them; a flow
    that only builds a path is dropped. Scans with a single path finding are left alone."""
    is_path = F.col("vulnerability_kind") == "PATH_TRAVERSAL"
    many = vulns.where(is_path).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_many", F.lit(True)).drop("_n")
    tagged = vulns.join(many, KEYS, "left").withColumn("_flow", is_path & F.coalesce("_many", F.lit(False))).drop("_many")
    flow = tagged.where("_flow").withColumn("_class", F.lower(F.trim(F.coalesce("class_name", F.lit(""))))).withColumn(
        "_label", F.lower(F.coalesce("taint_label", F.lit("")))).withColumn("_src", F.coalesce("source_file", "file")).withColumn("_pri", sink_priority())
    group = [*KEYS, "_src", "_class", "_label"]
    order = [F.col("_pri"), C.severity_rank(), C.confidence_rank(), F.col("vuln_id")]
    kept = _first(flow, group, order, n_originals=F.sum("n_originals")).where("_pri < 2")
    return tagged.where("not _flow").drop("_flow").unionByName(kept.select(*vulns.columns))


def auth_lookup(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """(class names with a login rule, (class name, method name) with one)."""
    cls = facts["classes"].where(C.has_any("attributes", ["AuthorizeAttribute"])).select(*KEYS, F.col("name").alias("class_name")).distinct()
    names = facts["classes"].select(*KEYS, F.col("class_id").alias("containing_class_id"), F.col("name").alias("class_name"))
    meth = facts["methods"].where(C.method_flags()["has_authorize"]).join(names, [*KEYS, "containing_class_id"]).select(
        *KEYS, "class_name", F.col("name").alias("method_name")).distinct()
    return cls, meth


def has_auth(vulns: DataFrame, facts: Facts) -> DataFrame:
    """Adds has_auth: a class of that name, or the named method in it, asks for a login. A finding
    without class name looks at all classes of the scan."""
    cls, meth = auth_lookup(facts)
    yes = lambda n: F.lit(True).alias(n)
    any_class = cls.select(*KEYS).distinct().select(*KEYS, yes("_ac"))
    any_method = meth.select(*KEYS, "method_name").distinct().select(*KEYS, "method_name", yes("_am"))
    out = (
        vulns.join(cls.select(*KEYS, "class_name", yes("_c")), [*KEYS, "class_name"], "left")
        .join(meth.select(*KEYS, "class_name", "method_name", yes("_m")), [*KEYS, "class_name", "method_name"], "left")
        .join(any_class, KEYS, "left").join(any_method, [*KEYS, "method_name"], "left")
    )
    named = F.coalesce(F.length("class_name"), F.lit(0)) > 0
    found = F.when(named, F.coalesce("_c", "_m", F.lit(False))).otherwise(F.coalesce("_ac", "_am", F.lit(False)))
    return out.withColumn("has_auth", found).drop("_c", "_m", "_ac", "_am").select(*vulns.columns, "has_auth")


def adjust_severity(vulns: DataFrame, facts: Facts) -> DataFrame:
    """Score by context; the new score is kept only when the severity band changes."""
    v = has_auth(vulns, facts) if "has_auth" not in vulns.columns else vulns
    s = F.col("cvss_score")
    s = F.when(F.col("is_entry_point") & ~F.col("has_auth"), F.least(F.lit(10.0), s + 0.5)).otherwise(s)
    s = F.when(F.col("has_partial_sanitizer") & (F.col("confidence") != "confirmed"), F.greatest(F.lit(0.0), s - 1.0)).otherwise(s)
    s = F.when(F.col("confidence") == "low", F.greatest(F.lit(0.0), s - 1.5)).otherwise(s)
    v = v.withColumn("_score", s).withColumn("_band", C.severity("_score"))
    moved = F.col("_band") != F.col("severity")
    return v.withColumn("cvss_score", F.when(moved, F.col("_score")).otherwise(F.col("cvss_score"))).withColumn(
        "severity", F.when(moved, F.col("_band")).otherwise(F.col("severity"))).drop("_score", "_band", "has_auth")


def order_vulns(vulns: DataFrame, final: bool = False) -> DataFrame:
    """Report order: severity, confidence, line. The final report sorts confidence as text."""
    conf = F.col("confidence") if final else C.confidence_rank()
    return vulns.orderBy(C.severity_rank(), conf, "line", "vuln_id")


def numbered(vulns: DataFrame) -> DataFrame:
    """Adds `position`, the place in report order inside each scan."""
    return ranked(vulns, KEYS, [C.severity_rank(), C.confidence_rank(), F.col("line"), F.col("vuln_id")], "position")


def classify_all(facts: Facts, taint: DataFrame, patterns: DataFrame, framework: DataFrame) -> DataFrame:
    """Findings to final vulnerabilities."""
    every = checkpoint(classify(facts, taint, patterns, framework))
    return adjust_severity(consolidate_flows(consolidate(dedupe_id(every))), facts)


# --- configuration and views of results -----------------------------------------------------


def glob_regex(glob: str) -> str:
    """A file or method glob as a regular expression."""
    out = ""
    for ch in glob.replace("**/", "\0"):
        out += {"*": "[^/]*", "?": "[^/]", "\0": "(.*/)?"}.get(ch, ch if ch.isalnum() or ch in "_/-" else "\\" + ch)
    return f"^{out}$"


def apply_report_filters(
    vulns: DataFrame, min_severity: str = "INFO", min_confidence: str = "low", exclude_files: tuple[str, ...] = (), exclude_methods: tuple[str, ...] = (),
) -> DataFrame:
    out = vulns.where(C.severity_rank() <= C.SEVERITIES.index(min_severity)).where(C.confidence_rank() <= C.CONFIDENCES.index(min_confidence))
    for g in exclude_files:
        out = out.where(~F.coalesce(F.col("file").rlike(glob_regex(g)), F.lit(False)))
    for g in exclude_methods:
        out = out.where(~F.coalesce(F.col("method_name").rlike(glob_regex(g)), F.lit(False)))
    return out


def apply_overrides(vulns: DataFrame, overrides: DataFrame) -> DataFrame:
    """`overrides(vulnerability_kind, enabled, severity_override)`: drop switched-off kinds, replace
    severities; of two rows of a kind the smaller counts. One row per kind, so the table is at most as long as the list of kinds."""
    o = overrides.groupBy("vulnerability_kind").agg(F.min(F.struct("enabled", "severity_override")).alias("_o")).select("vulnerability_kind", "_o.*")
    return vulns.join(o, "vulnerability_kind", "left").where("coalesce(enabled, true)").withColumn(
        "severity", F.coalesce("severity_override", "severity")).drop("enabled", "severity_override").select(*vulns.columns)


def search_findings(vulns: DataFrame, severity: str = "ALL", query: str = "") -> DataFrame:
    """Findings of a severity whose text contains the query."""
    text = F.lower(F.concat_ws(" ", "title", "file", "method_name", "class_name", "vulnerability_kind", "cwe", "code_snippet"))
    out = vulns if severity == "ALL" else vulns.where(F.col("severity") == severity)
    return out.where(text.contains(query.strip().lower())) if query.strip() else out


def to_api_finding(vulns: DataFrame) -> DataFrame:
    """Flat record for programs that read findings."""
    return vulns.select(
        *KEYS, F.col("vuln_id").alias("id"), "title", F.lower("severity").alias("severity"), "confidence", F.col("vulnerability_kind").alias("kind"), "cwe",
        "file", F.col("sink_line").alias("line"), "description", "remediation",
        F.struct("finding_source", "method_name", "class_name", "cvss_score").alias("metadata"))
