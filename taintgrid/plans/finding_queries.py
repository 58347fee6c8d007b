"""Queries over findings in document lines: classification, reports, history, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.operators import build as B
from taintgrid.operators import classify as K
from taintgrid.operators import history as H
from taintgrid.operators import report as R
from taintgrid.operators import verdicts as D
from taintgrid.operators.patterns import load_patterns, match_patterns
from taintgrid.operators.frameworks import rule_deprecated
from taintgrid.operators.taint import string_injection
from taintgrid.plans import views as V
from taintgrid.plans.cases import case
from taintgrid.plans.scan import run_scan
from taintgrid.plans.views import _values, fact_ctes, facts
from taintgrid.session import KEYS
from taintgrid.sources.catalog import load_rules, load_sink_kinds

# rule, pattern (common to Java and RE2), kind, cwe, score
LINE_RULES = [
    ("DOC-MAIL", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", "LOG_INJECTION", "CWE-117", 5.3),
    ("DOC-IP", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "SSRF", "CWE-918", 8.6),
    ("DOC-DIGITS", r"[0-9]{13,19}", "UNKNOWN", "CWE-693", 3.5),
    ("DOC-TOKEN", r'token = "', "SQL_INJECTION", "CWE-89", 9.8),
    ("DOC-LICENSE", r"(?i)license", "PATH_TRAVERSAL", "CWE-22", 7.5),
    ("DOC-JUNK", r"[%#*]{3,}", "XSS", "CWE-79", 6.1),
    ("DOC-CAPS", r"[A-Z]{6,}", "OPEN_REDIRECT", "CWE-601", 6.1),
]
# What each match of a rule's pattern holds, so that plain search spares most lines the pattern.
LINE_GUARDS = {"DOC-MAIL": "@", "DOC-IP": ".", "DOC-TOKEN": "token = "}
_SHAPE = """
lang AS project_id, source AS scan_id, 'docs/' || CAST(doc_id % 4 AS STRING) || '.txt' AS file, CAST(line AS INT) AS line, CAST(line AS INT) AS sink_line,
rule_id, kind AS vulnerability_kind, cwe, score AS cvss_score, t AS code_snippet,
CASE (doc_id + line) % 3 WHEN 0 THEN 'taint' WHEN 1 THEN 'pattern' ELSE 'framework' END AS finding_source,
CASE line % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'INFO' END AS severity,
'm' || CAST(line % 5 AS STRING) AS method_name, 'c' || CAST(doc_id % 10 AS STRING) AS class_name, line % 5 = 0 AS has_partial_sanitizer,
line % 7 = 0 AS is_in_loop, doc_id % 2 = 0 AS is_entry_point, 'd' || CAST(doc_id AS STRING) || '_' || CAST(line AS STRING) || '_' || rule_id AS finding_id, doc_id"""
_RULES_SQL = _values([(r, p, k, c, s) for r, p, k, c, s in LINE_RULES], "rule_id, pattern, kind, cwe, score")
_DOC = f"""dl AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
raw AS (SELECT dl.*, r.* FROM dl JOIN {_RULES_SQL} r ON regexp_matches(t, pattern)),
dv AS (SELECT {_SHAPE}, substr(sha256('docs/' || CAST(doc_id % 4 AS STRING) || '.txt:' || CAST(line AS STRING) || ':' || kind), 1, 16) AS vuln_id FROM raw)"""
RANKS = """CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"""
CONF = """CASE confidence WHEN 'confirmed' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"""
SRC = """CASE finding_source WHEN 'taint' THEN 0 WHEN 'pattern' THEN 1 ELSE 2 END"""
_DEDUPE = f"""dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, scan_id, vuln_id ORDER BY {CONF}, {SRC}, finding_id) AS rn,
  count(*) OVER (PARTITION BY project_id, scan_id, vuln_id) AS n_originals FROM dv) WHERE rn = 1)"""
_CONS = f"""cn AS (SELECT * EXCLUDE (rn, n0, t, p, confidence, finding_source, n_originals), n0 AS n_originals, CASE WHEN t AND p AND confidence = 'high' THEN 'confirmed' ELSE confidence END AS confidence,
  CASE WHEN t AND p THEN 'combined' ELSE finding_source END AS finding_source FROM (SELECT *, row_number() OVER (PARTITION BY project_id, scan_id, file, sink_line, vulnerability_kind ORDER BY {CONF}, {SRC}, vuln_id) AS rn,
  sum(n_originals) OVER (PARTITION BY project_id, scan_id, file, sink_line, vulnerability_kind) AS n0, bool_or(finding_source = 'taint') OVER (PARTITION BY project_id, scan_id, file, sink_line, vulnerability_kind) AS t,
  bool_or(finding_source = 'pattern') OVER (PARTITION BY project_id, scan_id, file, sink_line, vulnerability_kind) AS p FROM dd) WHERE rn = 1)"""


def docs(*extra: str) -> str:
    return "WITH " + ",\n".join([_DOC, *extra]) + "\n"


def doc_lines(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("_i", "t")).select(
        "doc_id", "lang", "source", (F.col("_i") + 1).alias("line"), "t")


def doc_findings(spark, d):
    """One row per (document line, rule) hit. Each line is tested against all rules in one pass."""
    hits = F.array_compact(F.array(*[
        F.when(F.contains("t", F.lit(LINE_GUARDS.get(r, ""))) & F.col("t").rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(k).alias("kind"), F.lit(c).alias("cwe"), F.lit(s).alias("score")))
        for r, p, k, c, s in LINE_RULES]))
    raw = doc_lines(spark, d).withColumn("r", F.explode(hits)).select("doc_id", "lang", "source", "line", "t", "r.*")
    v = V.run_sql(spark, d, f"SELECT {_SHAPE} FROM {{raw}}", {"raw": raw})
    none = F.lit(None).cast("string")
    return v.withColumns({
        "vuln_id": C.stable_id("file", "line", "vulnerability_kind"), "vector": F.lit("CVSS:3.1"), "title": F.col("vulnerability_kind"), "description": F.col("rule_id"),
        "remediation": F.concat(F.lit("fix "), F.col("rule_id")), "source_label": none, "sink_label": none, "taint_label": none, "source_file": F.col("file"), "method_id": F.col("method_name")})


def deduped(spark, d):
    return K.dedupe_id(doc_findings(spark, d))


def final(spark, d):
    return K.consolidate(deduped(spark, d))


# --- flagship -----------------------------------------------------------------------------

_GATE = f"""g AS (SELECT project_id, scan_id, count(*) AS total, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in C.SEVERITIES)},
  count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS blocking FROM cn GROUP BY 1, 2)"""


@case("flagship_document_gate", docs(_DEDUPE, _CONS, _GATE) + """
SELECT project_id, scan_id, total, critical, high, medium, low, info,
  CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' WHEN low > 0 THEN 'LOW' ELSE 'CLEAN' END AS risk_level, blocking, blocking = 0 AS passes_gate FROM g""")
def flagship_document_gate(spark, d):
    v = final(spark, d)
    blocking = F.count_if(F.col("severity").isin("CRITICAL", "HIGH"))
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in C.SEVERITIES]
    g = v.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total"), *counts, blocking.alias("blocking"))
    return g.withColumn("risk_level", C.risk_level(*[F.col(s.lower()) for s in C.SEVERITIES[:4]])).withColumn("passes_gate", F.col("blocking") == 0)


# --- classification -----------------------------------------------------------------------


@case("cls_stable_id", docs() + "SELECT finding_id, vuln_id, severity FROM dv")
def cls_stable_id(spark, d):
    return doc_findings(spark, d).select("finding_id", "vuln_id", C.severity("cvss_score").alias("severity"))


@case("cls_originals", docs() + "SELECT DISTINCT project_id, scan_id, vuln_id, finding_id FROM dv")
def cls_originals(spark, d):
    return K.originals(doc_findings(spark, d)).select(*KEYS, "vuln_id", "finding_id")


@case("cls_dedupe", docs(_DEDUPE) + "SELECT project_id, scan_id, vuln_id, finding_id, confidence, n_originals FROM dd")
def cls_dedupe(spark, d):
    return deduped(spark, d).select(*KEYS, "vuln_id", "finding_id", "confidence", "n_originals")


@case("cls_consolidate", docs(_DEDUPE, _CONS) + "SELECT project_id, scan_id, vuln_id, finding_source, confidence, CAST(n_originals AS BIGINT) AS n_originals FROM cn")
def cls_consolidate(spark, d):
    return final(spark, d).select(*KEYS, "vuln_id", "finding_source", "confidence", "n_originals")


_PATHS = f"""pv AS (SELECT *, CASE WHEN contains(lower(code_snippet), 'exists') THEN 1 WHEN contains(lower(code_snippet), 'getfullpath') OR contains(lower(code_snippet), 'combine') THEN 2 ELSE 1 END AS pri,
  count(*) OVER (PARTITION BY project_id, scan_id) AS n_path FROM cn WHERE vulnerability_kind = 'PATH_TRAVERSAL'),
pf AS (SELECT *, row_number() OVER (PARTITION BY project_id, scan_id, file, lower(class_name) ORDER BY pri, {RANKS}, {CONF}, vuln_id) AS rn,
  sum(n_originals) OVER (PARTITION BY project_id, scan_id, file, lower(class_name)) AS total FROM pv)"""


@case("cls_consolidate_flows", docs(_DEDUPE, _CONS, _PATHS) + """
SELECT project_id, scan_id, vuln_id, CAST(n_originals AS BIGINT) AS n_originals FROM cn WHERE vulnerability_kind <> 'PATH_TRAVERSAL'
UNION ALL SELECT project_id, scan_id, vuln_id, CAST(CASE WHEN n_path > 1 THEN total ELSE n_originals END AS BIGINT) FROM pf WHERE n_path <= 1 OR (rn = 1 AND pri < 2)""")
def cls_consolidate_flows(spark, d):
    return K.consolidate_flows(final(spark, d)).select(*KEYS, "vuln_id", "n_originals")


_SCORE = f"""sc AS (SELECT *, greatest(0.0, CASE WHEN confidence = 'low' THEN s2 - 1.5 ELSE s2 END) AS s3 FROM (
  SELECT *, CASE WHEN has_partial_sanitizer AND confidence <> 'confirmed' THEN greatest(0.0, s1 - 1.0) ELSE s1 END AS s2 FROM (
    SELECT *, CASE WHEN is_entry_point AND class_name <> 'c3' THEN least(10.0, cvss_score + 0.5) ELSE cvss_score END AS s1 FROM cn))),
sb AS (SELECT *, CASE WHEN s3 >= 9 THEN 'CRITICAL' WHEN s3 >= 7 THEN 'HIGH' WHEN s3 >= 4 THEN 'MEDIUM' WHEN s3 > 0 THEN 'LOW' ELSE 'INFO' END AS band FROM sc)"""


@case("cls_adjust_severity", docs(_DEDUPE, _CONS, _SCORE) + """
SELECT project_id, scan_id, vuln_id, band AS severity, round(CASE WHEN band <> severity THEN s3 ELSE cvss_score END, 4) AS cvss_score FROM sb""")
def cls_adjust_severity(spark, d):
    v = final(spark, d).withColumn("has_auth", F.col("class_name") == "c3")
    return K.adjust_severity(v, {}).select(*KEYS, "vuln_id", "severity", F.round("cvss_score", 4).alias("cvss_score"))


@case("cls_has_auth", fact_ctes() + """
SELECT c.name AS class_name, m.name AS method_name, bool_or(c2.hit) AS has_auth, count(*) AS n FROM f_methods m JOIN f_classes c ON c.project_id = m.project_id AND c.class_id = m.class_id
JOIN (SELECT project_id, name, bool_or(attrs LIKE '%Authorize%') AS hit FROM f_classes GROUP BY 1, 2) c2 ON c2.project_id = c.project_id AND c2.name = c.name GROUP BY 1, 2""")
def cls_has_auth(spark, d):
    f = facts(spark, d)
    rows = B.methods_with_class(f).select(*KEYS, "class_name", F.col("name").alias("method_name"))
    return K.has_auth(rows, f).groupBy("class_name", "method_name").agg(F.bool_or("has_auth").alias("has_auth"), F.count(F.lit(1)).alias("n"))


@case("cls_order", docs(_DEDUPE, _CONS) + f"SELECT project_id, scan_id, vuln_id, row_number() OVER (PARTITION BY project_id, scan_id ORDER BY {RANKS}, {CONF}, line, vuln_id) AS position FROM cn")
def cls_order(spark, d):
    return K.numbered(final(spark, d)).select(*KEYS, "vuln_id", "position")


_KINDS = _values([(kind, cwe, score) for kind, cwe, _, score in K.KINDS], "kind, cwe, score")


@case("scan_vulns")
def scan_vulns(spark, d):
    """The whole scan: every rule over the derived facts, classified, deduplicated and consolidated."""
    v = run_scan(facts(spark, d))["vulns"]
    return v.select(*KEYS, "vuln_id", "vulnerability_kind", "severity", "confidence", "finding_source", "file", "sink_line")


@case("cls_classify")
def cls_classify(spark, d):
    f = B.written(facts(spark, d))
    t = string_injection(f, load_sink_kinds(spark))
    p = match_patterns(f, load_patterns(spark), load_rules(spark))
    v = K.classify(f, t, p, rule_deprecated(f))
    return v.select(*KEYS, "finding_source", "vulnerability_kind", "severity", "cwe", "vector", "cvss_score", "vuln_id", "finding_id", "description")


@case("cls_taint_scores", docs() + f"""
SELECT finding_id, round(CASE WHEN NOT is_entry_point THEN greatest(0.0, up - 0.5) ELSE up END, 1) AS score FROM (
  SELECT v.*, CASE WHEN is_in_loop THEN least(10.0, k.score + 0.5) ELSE k.score END AS up FROM dv v JOIN {_KINDS} k ON k.kind = v.vulnerability_kind)""")
def cls_taint_scores(spark, d):
    v = doc_findings(spark, d).join(F.broadcast(K.load_kinds(spark)), "vulnerability_kind")
    return v.select("finding_id", K.taint_score(F.col("kind_score"), F.col("is_in_loop"), F.col("is_entry_point")).alias("score"))


@case("prj_fp_candidates", docs() + "SELECT finding_id, confidence = 'low' OR (has_partial_sanitizer AND confidence <> 'confirmed') AS fp FROM dv")
def prj_fp_candidates(spark, d):
    return doc_findings(spark, d).select("finding_id", C.is_fp_candidate().alias("fp"))


@case("prj_search", docs() + "SELECT finding_id FROM dv WHERE severity = 'HIGH' AND contains(lower(concat_ws(' ', vulnerability_kind, file, method_name, class_name, cwe, code_snippet)), '12')")
def prj_search(spark, d):
    return K.search_findings(doc_findings(spark, d), "HIGH", "12").select("finding_id")


@case("prj_report_filters", docs() + f"SELECT finding_id FROM dv WHERE {RANKS} <= 2 AND {CONF} <= 2 AND NOT regexp_matches(file, '^docs/1[^/]*[.]txt$') AND NOT regexp_matches(method_name, '^m4$')")
def prj_report_filters(spark, d):
    return K.apply_report_filters(doc_findings(spark, d), "MEDIUM", "medium", ("docs/1*.txt",), ("m4",)).select("finding_id")


@case("prj_overrides", docs() + "SELECT finding_id, CASE vulnerability_kind WHEN 'XSS' THEN 'CRITICAL' ELSE severity END AS severity FROM dv WHERE vulnerability_kind <> 'SSRF'")
def prj_overrides(spark, d):
    o = spark.createDataFrame([("XSS", True, "CRITICAL"), ("SSRF", False, None)], "vulnerability_kind string, enabled boolean, severity_override string")
    return K.apply_overrides(doc_findings(spark, d), o).select("finding_id", "severity")


@case("prj_api_findings", docs(_DEDUPE) + "SELECT vuln_id AS id, lower(severity) AS severity, sink_line AS line, project_id, scan_id, finding_source, cvss_score AS score FROM dd")
def prj_api_findings(spark, d):
    a = K.to_api_finding(deduped(spark, d))
    return a.select("id", "severity", "line", *KEYS, F.col("metadata.finding_source").alias("finding_source"), F.col("metadata.cvss_score").alias("score"))


# --- reports ----------------------------------------------------------------------------


@case("rpt_summary", docs(_DEDUPE, _CONS) + """
SELECT project_id, scan_id, dimension, value, count(*) AS n FROM (SELECT project_id, scan_id, unnest(['severity', 'kind', 'cwe', 'confidence', 'file', 'total']) AS dimension,
  unnest([severity, vulnerability_kind, cwe, confidence, regexp_replace(file, '^.*/', ''), '']) AS value FROM cn) GROUP BY ALL""")
def rpt_summary(spark, d):
    return R.summary(final(spark, d))


@case("rpt_top_files", docs(_DEDUPE, _CONS) + """
SELECT project_id, scan_id, file, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY project_id, scan_id ORDER BY n DESC, file) AS rn FROM (
  SELECT project_id, scan_id, regexp_replace(file, '^.*/', '') AS file, count(*) AS n FROM cn GROUP BY 1, 2, 3)) WHERE rn <= 5""")
def rpt_top_files(spark, d):
    return R.top_files(final(spark, d))


@case("rpt_top_kinds", docs(_DEDUPE, _CONS) + """
SELECT project_id, scan_id, vulnerability_kind, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY project_id, scan_id ORDER BY n DESC, vulnerability_kind) AS rn FROM (
  SELECT project_id, scan_id, vulnerability_kind, count(*) AS n FROM cn GROUP BY 1, 2, 3)) WHERE rn <= 8""")
def rpt_top_kinds(spark, d):
    return R.top_kinds(final(spark, d))


@case("rpt_header", docs(_DEDUPE, _CONS, _GATE) + """
SELECT project_id, scan_id, total, critical, high, medium, low, info, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' WHEN low > 0 THEN 'LOW' ELSE 'CLEAN' END AS risk_level FROM g""")
def rpt_header(spark, d):
    return R.scan_header(final(spark, d))


@case("rpt_remediation", docs(_DEDUPE, _CONS) + f"""
SELECT project_id, scan_id, vulnerability_kind, count(*) AS n, 'fix ' || arg_min(rule_id, struct_pack(a := {RANKS}, b := confidence, c := line, d := vuln_id)) AS primary_remediation FROM cn GROUP BY 1, 2, 3""")
def rpt_remediation(spark, d):
    return R.remediation_summary(final(spark, d)).select(*KEYS, "vulnerability_kind", "n", "primary_remediation")


@case("rpt_metrics", fact_ctes() + """
SELECT project_id, count(*) AS nodes, count(*) FILTER (is_san) AS sanitizers, count(DISTINCT file) AS files,
  (SELECT count(*) FROM f_methods m WHERE m.project_id = r.project_id) AS methods FROM f_role r GROUP BY 1""")
def rpt_metrics(spark, d):
    f = facts(spark, d)
    out = R.metrics(f["nodes"], string_injection(f, load_sink_kinds(spark)), match_patterns(f, load_patterns(spark), load_rules(spark)), rule_deprecated(f), f["methods"])
    return out.select("project_id", "nodes", "sanitizers", "files", "methods")


@case("rpt_code_context", docs() + """
SELECT v.finding_id, l.line AS line_no, l.t AS text, l.line = v.sink_line AS is_sink FROM dv v JOIN dl l ON l.doc_id = v.doc_id AND l.line BETWEEN greatest(1, v.sink_line - 2) AND v.sink_line + 2""")
def rpt_code_context(spark, d):
    v = doc_findings(spark, d).withColumn("file", F.col("doc_id").cast("string")).withColumn("vuln_id", F.col("finding_id"))
    src = V.table(spark, d, "documents").select(F.col("lang").alias("project_id"), F.col("source").alias("scan_id"), F.col("doc_id").cast("string").alias("file"), "text")
    return R.code_context(v, src).select(F.col("vuln_id").alias("finding_id"), "line_no", "text", "is_sink")


@case("rpt_sarif_rules", docs(_DEDUPE, _CONS) + f"""
SELECT project_id, scan_id, vulnerability_kind AS id, CASE WHEN min({RANKS}) <= 1 THEN 'error' WHEN min({RANKS}) = 2 THEN 'warning' ELSE 'note' END AS level,
  string_agg(DISTINCT finding_source, ',' ORDER BY finding_source) AS sources FROM cn GROUP BY 1, 2, 3""")
def rpt_sarif_rules(spark, d):
    return R.sarif_rules(final(spark, d)).select(*KEYS, "id", "level", F.array_join("finding_sources", ",").alias("sources"))


@case("rpt_sarif_results", docs(_DEDUPE, _CONS) + f"""
SELECT project_id, scan_id, vuln_id, vulnerability_kind AS rule, CASE WHEN {RANKS} <= 1 THEN 'error' WHEN {RANKS} = 2 THEN 'warning' ELSE 'note' END AS level, sink_line AS start_line,
  CASE WHEN sink_line > 0 THEN 1 ELSE 0 END AS n_related FROM cn""")
def rpt_sarif_results(spark, d):
    r = R.sarif_results(final(spark, d))
    return r.select(
        *KEYS, "vuln_id", F.col("result.ruleId").alias("rule"), F.col("result.level").alias("level"),
        F.get(F.col("result.locations"), F.lit(0))["physicalLocation"]["region"]["startLine"].alias("start_line"), F.size("result.relatedLocations").alias("n_related"))


@case("rpt_table", docs(_DEDUPE, _CONS) + f"""
SELECT project_id, scan_id, vuln_id, position, hidden FROM (SELECT *, row_number() OVER (PARTITION BY project_id, scan_id ORDER BY {RANKS}, confidence, line, vuln_id) AS position,
  greatest(count(*) OVER (PARTITION BY project_id, scan_id) - 3, 0) AS hidden FROM cn) WHERE position <= 3""")
def rpt_table(spark, d):
    return R.finding_table(final(spark, d), 3).select(*KEYS, "vuln_id", "position", "hidden")


@case("rpt_documents", docs(_DEDUPE, _CONS) + f"""
SELECT project_id, scan_id, CAST((o - 1) // 2 + 1 AS INT) AS page, vuln_id FROM (
  SELECT project_id, scan_id, vuln_id, row_number() OVER (PARTITION BY project_id, scan_id ORDER BY {RANKS}, confidence, line, vuln_id) AS o FROM cn)""")
def rpt_documents(spark, d):
    pages = R.report_documents(final(spark, d), "2024-01-01T00:00:00", page_rows=2)
    return pages.select(*KEYS, "page", F.explode("document.vulnerabilities.vuln_id").alias("vuln_id"))


@case("rpt_project_section", fact_ctes() + """
SELECT project_id, (SELECT count(*) FROM f_methods m WHERE m.project_id = c.project_id) AS methods, count(*) AS classes FROM f_classes c GROUP BY 1""")
def rpt_project_section(spark, d):
    from taintgrid.operators.frameworks import detect_frameworks, primary_framework
    from taintgrid.session import checkpoint
    from taintgrid.sources.facts import merge_meta

    f = facts(spark, d)
    det = checkpoint(detect_frameworks(f))
    return R.project_section(merge_meta(f["meta"]), f["methods"], f["classes"], primary_framework(det), det).select("project_id", "methods", "classes")


# --- history ------------------------------------------------------------------------------

_STORE = f"""hv AS (SELECT DISTINCT lang AS project_name, lang || '-' || source AS scan_id, substr(sha256(rule_id || ':' || t), 1, 16) AS vuln_id, kind AS vulnerability_kind,
  CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM raw),
sn AS (SELECT DISTINCT lang AS project_name, lang || '-' || source AS scan_id, CAST(substr(source, 4) AS INT) AS n FROM documents),
hs AS (SELECT s.project_name, s.scan_id, s.n, '2024-01-' || lpad(CAST(n + 1 AS STRING), 2, '0') || 'T00:00:00' AS scan_started_at, CASE WHEN n % 5 = 4 THEN 'failed' ELSE 'completed' END AS scan_status,
  n % 9 = 8 AS is_archived, CAST(n * 1.5 AS DOUBLE) AS scan_duration_sec, CASE WHEN n % 2 = 0 THEN 'aspnetcore' ELSE 'wcf' END AS framework,
  coalesce(t.total_vulns, 0) AS total_vulns, coalesce(t.critical, 0) AS critical, coalesce(t.high, 0) AS high, coalesce(t.medium, 0) AS medium, coalesce(t.low, 0) AS low, 0 AS info
  FROM sn s LEFT JOIN (SELECT project_name, scan_id, count(*) AS total_vulns, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
    count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM hv GROUP BY 1, 2) t ON t.project_name = s.project_name AND t.scan_id = s.scan_id)"""


def store(spark, d):
    """(scans, vulns) of the scan store."""
    hits = doc_findings(spark, d)
    vid = F.substring(F.sha2(F.concat_ws(":", "rule_id", "code_snippet"), 256), 1, 16)
    v = hits.select(
        F.col("project_id").alias("project_name"), F.concat_ws("-", "project_id", "scan_id").alias("scan_id"), vid.alias("vuln_id"), "vulnerability_kind", "severity").distinct()
    n = F.substring("source", 4, 10).cast("int")
    s = V.table(spark, d, "documents").select(F.col("lang").alias("project_name"), F.concat_ws("-", "lang", "source").alias("scan_id"), n.alias("n")).distinct()
    s = s.join(H.severity_summary(v), H.P, "left").na.fill(0, ["total_vulns", "critical", "high", "medium", "low", "info"])
    return s.withColumns({
        "scan_started_at": F.concat(F.lit("2024-01-"), F.lpad((F.col("n") + 1).cast("string"), 2, "0"), F.lit("T00:00:00")),
        "scan_status": F.when(F.col("n") % 5 == 4, "failed").otherwise("completed"), "is_archived": F.col("n") % 9 == 8,
        "scan_duration_sec": (F.col("n") * 1.5).cast("double"), "framework": F.when(F.col("n") % 2 == 0, "aspnetcore").otherwise("wcf")}), v


@case("his_severity_summary", docs(_STORE) + "SELECT project_name, scan_id, total_vulns, critical, high, medium, low FROM hs")
def his_severity_summary(spark, d):
    return store(spark, d)[0].select("project_name", "scan_id", "total_vulns", "critical", "high", "medium", "low")


@case("his_latest", docs(_STORE) + "SELECT project_name, arg_max(scan_id, struct_pack(a := scan_started_at, b := scan_id)) AS scan_id FROM hs WHERE scan_status = 'completed' GROUP BY 1")
def his_latest(spark, d):
    return H.latest_scan(store(spark, d)[0]).select("project_name", "scan_id")


@case("his_list", docs(_STORE) + """
SELECT project_name, scan_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY scan_started_at DESC, scan_id DESC) AS rn FROM hs WHERE NOT is_archived) WHERE rn <= 3""")
def his_list(spark, d):
    return H.list_scans(store(spark, d)[0], limit=3, per_project=True).select("project_name", "scan_id", "rn")


@case("his_recent", docs(_STORE) + "SELECT scan_id FROM hs WHERE NOT is_archived ORDER BY scan_started_at DESC, scan_id DESC LIMIT 7")
def his_recent(spark, d):
    return H.list_scans(store(spark, d)[0], limit=7).select("scan_id")


@case("his_scans_with", docs(_STORE) + """
SELECT scan_id FROM hs WHERE EXISTS (SELECT 1 FROM hv WHERE hv.scan_id = hs.scan_id AND vulnerability_kind = 'XSS') AND EXISTS (SELECT 1 FROM hv WHERE hv.scan_id = hs.scan_id AND severity = 'HIGH')""")
def his_scans_with(spark, d):
    return H.scans_with(*store(spark, d), "XSS", "HIGH").select("scan_id")


@case("his_scan_vulns", docs(_STORE, "one AS (SELECT min(scan_id) AS m FROM hv)") + "SELECT vuln_id, severity FROM hv JOIN one ON m = scan_id WHERE severity = 'MEDIUM'")
def his_scan_vulns(spark, d):
    v = store(spark, d)[1]
    return H.scan_vulns(v, v.agg(F.min("scan_id")).first()[0], severity="MEDIUM").select("vuln_id", "severity")


@case("his_counts", docs(_STORE) + "SELECT (SELECT count(*) FROM hs WHERE scan_status = 'failed') AS n_failed, (SELECT count(DISTINCT project_name) FROM hs) AS n_projects")
def his_counts(spark, d):
    s = store(spark, d)[0]
    return s.agg(F.count_if(F.col("scan_status") == "failed").alias("n_failed"), F.countDistinct("project_name").alias("n_projects"))


_TREND = """last AS (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY scan_started_at DESC, scan_id DESC) AS rn FROM hs WHERE scan_status = 'completed'),
tp AS (SELECT project_name, arg_max(scan_id, rn) AS b, arg_min(scan_id, rn) AS a FROM last WHERE rn <= 4 GROUP BY 1 HAVING count(*) > 1),
mt AS (SELECT tp.project_name, tp.b, tp.a, x.vuln_id, bool_or(x.scan_id = tp.b) AS inb, bool_or(x.scan_id = tp.a) AS ina FROM tp JOIN hv x ON x.project_name = tp.project_name AND x.scan_id IN (tp.a, tp.b) GROUP BY ALL)"""


@case("his_trend", docs(_STORE, _TREND) + """
SELECT tp.project_name, tp.b AS scan_before, tp.a AS scan_after, y.total_vulns - x.total_vulns AS total_delta, y.critical - x.critical AS critical_delta, y.medium - x.medium AS medium_delta,
  (SELECT count(*) FROM mt WHERE mt.project_name = tp.project_name AND NOT inb) AS n_new, (SELECT count(*) FROM mt WHERE mt.project_name = tp.project_name AND NOT ina) AS n_resolved,
  (SELECT count(*) FROM mt WHERE mt.project_name = tp.project_name AND inb AND ina) AS n_persistent FROM tp JOIN hs x ON x.scan_id = tp.b JOIN hs y ON y.scan_id = tp.a""")
def his_trend(spark, d):
    return H.trend(*store(spark, d), n=4).select(
        "project_name", "scan_before", "scan_after", "total_delta", "critical_delta", "medium_delta", "n_new", "n_resolved", "n_persistent")


@case("his_match_scans", docs(_STORE, _TREND) + "SELECT project_name, vuln_id, CASE WHEN NOT inb THEN 'new' WHEN NOT ina THEN 'resolved' ELSE 'persistent' END AS status FROM mt")
def his_match_scans(spark, d):
    s, v = store(spark, d)
    return H.trend_vulns(v, H.trend_pairs(s, 4)).select("project_name", "vuln_id", "status")


@case("his_trend_lists", docs(_STORE, _TREND) + """
SELECT project_name, status, vuln_id FROM (SELECT *, row_number() OVER (PARTITION BY project_name, status ORDER BY vuln_id) AS rn FROM (
  SELECT project_name, vuln_id, CASE WHEN NOT inb THEN 'new' WHEN NOT ina THEN 'resolved' ELSE 'persistent' END AS status FROM mt)) WHERE rn <= CASE status WHEN 'persistent' THEN 10 ELSE 20 END""")
def his_trend_lists(spark, d):
    s, v = store(spark, d)
    return H.trend_lists(v, H.trend_pairs(s, 4)).select("project_name", "status", "vuln_id")


@case("his_gate", docs(_STORE) + """
SELECT project_name, scan_id, total_vulns, critical + high AS blocking_count, critical + high = 0 AND total_vulns <= 5 AS passes_gate,
  CASE WHEN critical + high = 0 AND total_vulns <= 5 THEN 0 ELSE 1 END AS exit_code, CASE WHEN critical + high = 0 AND total_vulns <= 0 THEN 0 ELSE 1 END AS console_exit_code FROM hs""")
def his_gate(spark, d):
    return H.gate(*store(spark, d), "HIGH", 5)


@case("his_changes", docs(_STORE) + """
SELECT scan_id, is_archived OR n % 3 = 0 AS is_archived, CASE WHEN n % 2 = 0 THEN 'a,b' ELSE 'a' END AS tags FROM hs""")
def his_changes(spark, d):
    s = store(spark, d)[0].withColumn("tags", F.array(F.lit("a")))
    t = s.where("n % 2 = 0").select("scan_id", F.array(F.lit("a"), F.lit("b")).alias("tags"))
    out = H.add_tags(H.archive(s, s.where("n % 3 = 0").select("scan_id")), t)
    return out.select("scan_id", "is_archived", F.array_join("tags", ",").alias("tags"))


@case("his_progress", "SELECT CAST(user_id AS STRING) AS scan_id, arg_max(event_type, struct_pack(a := ts, b := event_type)) AS status FROM events GROUP BY 1")
def his_progress(spark, d):
    ev = V.table(spark, d, "events")
    u = ev.select(F.col("user_id").cast("string").alias("scan_id"), F.col("ts").alias("updated_at"), F.col("event_type").alias("status"), F.col("props").alias("message"))
    return H.progress(u).select("scan_id", "status")


@case("his_retain", docs(_STORE) + """
SELECT scan_id FROM (SELECT *, row_number() OVER (PARTITION BY project_name ORDER BY scan_started_at DESC, scan_id DESC) AS rn FROM hs) WHERE rn <= 10 AND n <> 3""")
def his_retain(spark, d):
    s = store(spark, d)[0]
    return H.delete_scans(H.retain(s, 10), s.where("n = 3").select("scan_id")).select("scan_id")


@case("his_stats", docs(_STORE) + """
SELECT project_name, count(*) AS total_scans, count(*) FILTER (scan_status = 'completed') AS completed_scans, count(*) FILTER (scan_status = 'failed') AS failed_scans,
  CAST(sum(total_vulns) FILTER (scan_status = 'completed') AS BIGINT) AS total_vulns_found, min(scan_started_at) FILTER (scan_status = 'completed') AS first_scan_at,
  max(scan_started_at) FILTER (scan_status = 'completed') AS last_scan_at, CAST(sum(medium) FILTER (scan_status = 'completed') AS BIGINT) AS medium FROM hs GROUP BY 1""")
def his_stats(spark, d):
    return H.scan_stats(store(spark, d)[0]).select(
        "project_name", "total_scans", "completed_scans", "failed_scans", "total_vulns_found", "first_scan_at", "last_scan_at", "medium")


@case("his_kind_counts", docs(_STORE) + """
SELECT vulnerability_kind, count(*) AS n FROM hv WHERE scan_id IN (SELECT scan_id FROM hs WHERE scan_status = 'completed') GROUP BY 1""")
def his_kind_counts(spark, d):
    return H.kind_counts(*store(spark, d), by=[]).select("vulnerability_kind", "n")


@case("his_framework_counts", docs(_STORE) + "SELECT project_name, framework, count(*) AS n FROM hs GROUP BY 1, 2")
def his_framework_counts(spark, d):
    return H.framework_counts(store(spark, d)[0])


@case("his_duration", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE round(value, 2) END AS seconds FROM events")
def his_duration(spark, d):
    ev = V.table(spark, d, "events")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    end = F.timestamp_micros((F.unix_micros(start) + F.round(F.col("value") * 1000000).cast("long")))
    return ev.select("event_id", C.duration_seconds(text(start), F.when(F.col("event_id") % 10 == 0, "soon").otherwise(text(end))).alias("seconds"))


@case("src_upsert_scans", docs(_STORE) + "SELECT scan_id, CASE WHEN n % 4 = 0 THEN 'partial' ELSE scan_status END AS scan_status FROM hs")
def src_upsert_scans(spark, d):
    s = store(spark, d)[0].withColumn("updated_at", F.col("scan_started_at"))
    up = s.where("n % 4 = 0").withColumn("scan_status", F.lit("partial")).withColumn("updated_at", F.lit("2025"))
    return H.upsert_scans(s, up).select("scan_id", "scan_status")


@case("src_complete_scans", docs(_STORE) + """
SELECT scan_id, total_vulns, CASE WHEN n % 3 > 0 THEN 'completed' WHEN total_vulns > 0 THEN 'partial' ELSE 'failed' END AS scan_status FROM hs""")
def src_complete_scans(spark, d):
    s, v = store(spark, d)
    running = s.withColumn("scan_status", F.lit("running"))
    failed = s.where("n % 3 = 0").select("scan_id", F.lit("boom").alias("error"))
    return H.complete_scans(running, v, "2024-03-01T00:00:00", failed).select("scan_id", "total_vulns", "scan_status")


@case("his_stored_shape", docs(_DEDUPE) + "SELECT project_id AS project_name, scan_id, vuln_id, code_snippet, cvss_score AS base FROM dd")
def his_stored_shape(spark, d):
    return H.to_stored(deduped(spark, d)).select("project_name", "scan_id", "vuln_id", "code_snippet", F.col("cvss.base_score").alias("base"))


# --- review -----------------------------------------------------------------------------

_SEL = f"""sel AS (SELECT *, row_number() OVER (PARTITION BY project_id, scan_id ORDER BY {RANKS}, {CONF}, line, vuln_id) AS review_no FROM cn
  WHERE confidence IN ('high', 'medium') AND NOT has_partial_sanitizer),
pick AS (SELECT * FROM sel WHERE review_no <= 50),
rt AS (SELECT *, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'single' ELSE 'batch' END AS route FROM pick),
rn AS (SELECT *, row_number() OVER (PARTITION BY project_id, scan_id, route ORDER BY review_no) AS k FROM rt)"""


@case("vrd_select", docs(_DEDUPE, _CONS, _SEL) + "SELECT project_id, scan_id, vuln_id, review_no FROM pick")
def vrd_select(spark, d):
    return D.select_for_review(final(spark, d), 50).select(*KEYS, "vuln_id", "review_no")


def routed(spark, d):
    return D.route_review(D.select_for_review(final(spark, d), 50))


@case("vrd_route", docs(_DEDUPE, _CONS, _SEL) + """
SELECT project_id, scan_id, vuln_id, route, CAST(CASE route WHEN 'batch' THEN (k - 1) // 5 + 1 ELSE k END AS INT) AS batch_no, CAST(CASE route WHEN 'batch' THEN (k - 1) % 5 + 1 ELSE 1 END AS INT) AS index FROM rn""")
def vrd_route(spark, d):
    return routed(spark, d).select(*KEYS, "vuln_id", "route", "batch_no", "index")


@case("vrd_method_context", fact_ctes() + """
SELECT method_id, string_agg('L' || CAST(line AS STRING) || ': ' || CASE WHEN is_source THEN '[SOURCE] ' WHEN is_sink THEN '[SINK] ' WHEN is_san THEN '[SANITIZER] ' ELSE '' END || text, chr(10) ORDER BY line, node_id) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, method_id ORDER BY line, node_id) AS rn FROM f_role) WHERE rn <= 20 GROUP BY project_id, method_id""")
def vrd_method_context(spark, d):
    return D.method_context(facts(spark, d)["nodes"], 20).select("method_id", "context")


@case("vrd_prompts", docs(_DEDUPE, _CONS, _SEL) + """
SELECT project_id, scan_id, route, batch_no, count(*) AS n FROM (SELECT *, CAST(CASE route WHEN 'batch' THEN (k - 1) // 5 + 1 ELSE k END AS INT) AS batch_no FROM rn) GROUP BY 1, 2, 3, 4""")
def vrd_prompts(spark, d):
    no_context = spark.createDataFrame([], "project_id string, scan_id string, method_id string, context string")
    return D.build_prompts(routed(spark, d), no_context).select(*KEYS, "route", "batch_no", F.size("vuln_ids").cast("long").alias("n"))


@case("vrd_score", "SELECT item_id, CAST(length(text) AS STRING) AS reply FROM benchmark")
def vrd_score(spark, d):
    prompts = V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return D.score(prompts, lambda s: s.str.len().astype(str)).select("item_id", "reply")


_FENCED = """'Here: ```json' || chr(10) || '{"is_false_positive": ' || CASE WHEN v % 2 = 0 THEN 'true' ELSE 'false' END || ', "reasoning": "value ' || CAST(v AS STRING) || '", "confidence_adjusted": "' ||
  CASE v % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' ELSE 'odd' END || '"}' || chr(10) || '```'"""
_REPLY = f"""rp AS (SELECT event_id, v, CASE WHEN v % 7 = 0 THEN props WHEN v % 7 = 1 THEN '{{"is_false_positive": true, "reasoning": "cut off' WHEN v % 7 = 2 THEN 'no answer' ELSE {_FENCED} END AS reply
  FROM (SELECT event_id, props, CAST(props->>'$.k' AS INT) AS v FROM events))"""


def replies(spark, d):
    ev = V.table(spark, d, "events").select("event_id", "props", F.get_json_object("props", "$.k").cast("int").alias("v"))
    sql = _FENCED.replace("chr(10)", "char(10)").replace("{", "{{").replace("}", "}}")
    return V.run_sql(
        spark, d, f"""SELECT event_id, v, CASE WHEN v % 7 = 0 THEN props WHEN v % 7 = 1 THEN '{{{{"is_false_positive": true, "reasoning": "cut off' WHEN v % 7 = 2 THEN 'no answer' ELSE {sql} END AS reply FROM {{ev}}""", {"ev": ev})


@case("vrd_clean_json", "WITH " + _REPLY + """
SELECT event_id, CASE WHEN v % 7 IN (0, 2) THEN reply WHEN v % 7 = 1 THEN reply ELSE regexp_extract(replace(reply, chr(10), ' '), '(\\{.*\\})', 1) END AS json FROM rp""")
def vrd_clean_json(spark, d):
    return replies(spark, d).select("event_id", D.clean_json("reply").alias("json"))


@case("vrd_parse", "WITH " + _REPLY + """
SELECT event_id, CASE WHEN v % 7 = 2 THEN 'keep' WHEN v % 7 = 1 THEN 'fields' ELSE 'json' END AS verdict_source, CASE WHEN v % 7 = 1 THEN true WHEN v % 7 IN (0, 2) THEN false ELSE v % 2 = 0 END AS is_false_positive,
  CASE WHEN v % 7 > 2 THEN CASE v % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END END AS confidence_adjusted FROM rp""")
def vrd_parse(spark, d):
    return D.parse_verdicts(replies(spark, d)).select("event_id", "verdict_source", "is_false_positive", "confidence_adjusted")


@case("vrd_reply_valid", "WITH " + _REPLY + "SELECT event_id, v % 7 > 2 AS ok FROM rp")
def vrd_reply_valid(spark, d):
    return replies(spark, d).select("event_id", D.reply_is_valid("verdict", D.clean_json("reply")).alias("ok"))


@case("vrd_parse_batch", docs(_DEDUPE, _CONS, _SEL, "bt AS (SELECT *, CAST((k - 1) // 5 + 1 AS INT) AS batch_no, (k - 1) % 5 + 1 AS index FROM rn WHERE route = 'batch')") + """
SELECT project_id, scan_id, vuln_id, CASE WHEN batch_no % 3 = 2 THEN index = 2 WHEN batch_no % 3 = 0 THEN false ELSE index = 1 END AS is_false_positive,
  CASE WHEN batch_no % 3 = 0 THEN 'keep' WHEN batch_no % 3 = 2 THEN 'fields' WHEN index IN (1, 2) THEN 'json' ELSE 'keep' END AS verdict_source FROM bt WHERE batch_no % 3 <> 2 OR index = 2""")
def vrd_parse_batch(spark, d):
    r = routed(spark, d)
    answers = r.where("route = 'batch'").select(*KEYS, "batch_no").distinct().withColumn("reply", F.when(
        F.col("batch_no") % 3 == 1, '{"findings": [{"index": 1, "is_likely_fp": true, "reason": "x"}, {"index": 2, "is_likely_fp": false, "reason": "y"}]}').when(
        F.col("batch_no") % 3 == 2, '{"findings": [{"index": 2, "is_likely_fp": true, "reason": "cut').otherwise("sorry"))
    return D.parse_batch(answers, r).select(*KEYS, "vuln_id", "is_false_positive", "verdict_source")


_LAB = "lab AS (SELECT doc_id, quality, toxic FROM labels)"


@case("vrd_apply", docs(_LAB) + """
SELECT v.finding_id, CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 0 AND l.quality = 0 THEN 'low' ELSE v.confidence END AS confidence, coalesce(l.toxic = 1, false) AS fp_suggested, l.doc_id IS NOT NULL AS is_reviewed
FROM dv v LEFT JOIN lab l ON l.doc_id = v.doc_id""")
def vrd_apply(spark, d):
    v = doc_findings(spark, d).withColumn("vuln_id", F.col("finding_id"))
    lab = V.table(spark, d, "labels")
    verdicts = v.select(*KEYS, "vuln_id", "doc_id").join(lab, "doc_id").select(
        *KEYS, "vuln_id", (F.col("toxic") == 1).alias("is_false_positive"), F.when(F.col("quality") == 0, "low").alias("confidence_adjusted"), F.lit("label").alias("reasoning"))
    return D.apply_verdicts(v, verdicts).select("finding_id", "confidence", "fp_suggested", "is_reviewed")


@case("vrd_stats", docs(_DEDUPE, _CONS, _SEL) + """
SELECT project_id, scan_id, count(*) AS confirmed, (SELECT count(*) FROM pick p WHERE p.project_id = cn.project_id AND p.scan_id = cn.scan_id) AS analyzed, 0 AS false_positives,
  count(*) - (SELECT count(*) FROM pick p WHERE p.project_id = cn.project_id AND p.scan_id = cn.scan_id) AS skipped, 0.0 AS reduction_pct FROM cn GROUP BY 1, 2""")
def vrd_stats(spark, d):
    v = final(spark, d)
    return D.review_stats(v, D.select_for_review(v, 50))
