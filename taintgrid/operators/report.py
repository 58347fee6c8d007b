"""Report aggregates per scan, and the JSON and SARIF shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.operators.classify import references
from taintgrid.session import KEYS, ranked, top_n

PAGE_ROWS = 1000  # findings per report document; a larger scan has several documents


def _order() -> list[Column]:
    return [C.severity_rank(), F.col("confidence"), F.col("line"), F.col("vuln_id")]


def summary(vulns: DataFrame) -> DataFrame:
    """(keys, dimension, value, n): counts by severity, kind, cwe, confidence, file, and the total, in
    one pass over the findings."""
    dims = {"severity": "severity", "kind": "vulnerability_kind", "cwe": "cwe", "confidence": "confidence"}
    rows = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in dims.items()],
        F.struct(F.lit("file").alias("dimension"), C.basename("file").alias("value")),
        F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")))
    return vulns.select(*KEYS, F.explode(rows).alias("r")).groupBy(*KEYS, "r.dimension", "r.value").agg(F.count(F.lit(1)).alias("n"))


def top_files(vulns: DataFrame, n: int = 5) -> DataFrame:
    counts = vulns.groupBy(*KEYS, C.basename("file").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return top_n(counts, KEYS, [F.col("n").desc(), F.col("file")], n)


def top_kinds(vulns: DataFrame, n: int = 8) -> DataFrame:
    counts = vulns.groupBy(*KEYS, "vulnerability_kind").agg(F.count(F.lit(1)).alias("n"))
    return top_n(counts, KEYS, [F.col("n").desc(), F.col("vulnerability_kind")], n)


def scan_header(vulns: DataFrame) -> DataFrame:
    """Per scan: totals by severity and the risk level."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in C.SEVERITIES]
    out = vulns.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total"), *counts)
    return out.withColumn("risk_level", C.risk_level(*[F.col(s.lower()) for s in C.SEVERITIES[:4]]))


def remediation_summary(vulns: DataFrame) -> DataFrame:
    """Per scan and kind: count, the first remediation in report order, references."""
    order = F.struct(*_order())
    out = vulns.groupBy(*KEYS, "vulnerability_kind").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("remediation", F.when(F.length("remediation") > 0, order)).alias("primary_remediation"),
        F.min_by("cwe", order).alias("cwe"))
    return out.withColumn("references", references(F.col("cwe")))


def metrics(nodes: DataFrame, taint: DataFrame, patterns: DataFrame, framework: DataFrame, methods: DataFrame) -> DataFrame:
    """Per scan: files, methods, nodes, distinct sources and sinks of findings, sanitizers, paths, matches."""
    n = nodes.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if("is_known_sanitizer").alias("sanitizers"), F.countDistinct("file").alias("files"))
    m = methods.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("methods"))
    t = taint.groupBy(*KEYS).agg(
        F.countDistinct("source_node_id").alias("sources"), F.countDistinct("sink_node_id").alias("sinks"), F.count(F.lit(1)).alias("taint_paths"))
    p = patterns.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("pattern_matches"))
    f = framework.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("framework_findings"))
    out = n
    for d in (m, t, p, f):
        out = out.join(d, KEYS, "full_outer")
    return out.na.fill(0)


def code_context(vulns: DataFrame, sources: DataFrame, radius: int = 2) -> DataFrame:
    """(keys, vuln_id, line_no, text, is_sink): source lines around the sink; where the file is not
    there, the first five snippet lines with line 0.

    `sources(keys, file, text)`. A finding asks for its few line numbers, so the join is by equality
    on (file, line), and a file's text is cut once.
    """
    v = vulns.select(*KEYS, "vuln_id", "file", "sink_line", "code_snippet")
    lines = sources.select(*KEYS, "file", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("_i", "text")).select(
        *KEYS, "file", (F.col("_i") + 1).alias("line_no"), "text")
    lo = F.greatest(F.lit(1), F.col("sink_line") - radius)
    want = v.where("sink_line > 0").select(*KEYS, "vuln_id", "file", "sink_line", F.explode(F.sequence(lo, F.col("sink_line") + radius)).alias("line_no"))
    found = want.join(lines, [*KEYS, "file", "line_no"]).select(
        *KEYS, "vuln_id", "line_no", "text", (F.col("line_no") == F.col("sink_line")).alias("is_sink"))
    have = sources.select(*KEYS, "file").distinct()
    bare = v.join(have, [*KEYS, "file"], "left_anti").unionByName(v.where("sink_line <= 0").join(have, [*KEYS, "file"], "left_semi"))
    snippet = F.trim(F.coalesce("code_snippet", F.lit("")))
    rest = bare.where(F.length(snippet) > 0).select(
        *KEYS, "vuln_id", F.posexplode(F.slice(F.split(snippet, r"\r\n|\r|\n"), 1, 5)).alias("_i", "text"))
    return found.unionByName(rest.select(*KEYS, "vuln_id", F.lit(0).alias("line_no"), "text", (F.col("_i") == 0).alias("is_sink")))


def finding_table(vulns: DataFrame, n: int = 50) -> DataFrame:
    """The first n findings per scan, with the number left out."""
    total = vulns.groupBy(*KEYS).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("hidden"))
    return top_n(vulns, KEYS, _order(), n, "position").join(total, KEYS)


def project_section(meta: DataFrame, methods: DataFrame, classes: DataFrame, primary: DataFrame, detected: DataFrame) -> DataFrame:
    """Scan header: language, files, classes, methods, primary framework, detected frameworks."""
    n = lambda d, name: d.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(name))
    names = detected.groupBy(*KEYS).agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))  # at most 11 names
    out = primary
    for d in (names, n(methods, "methods"), n(classes, "classes"), meta.select(*KEYS, "language_version", "n_files", "n_nuget_references")):
        out = out.join(d, KEYS, "left")
    return out.na.fill(0)


# --- SARIF ------------------------------------------------------------------------------


def sarif_level(rank: Column) -> Column:
    return F.when(rank <= 1, "error").when(rank == 2, "warning").otherwise("note")


def help_uri(cwe: Column, refs: Column, kind: Column) -> Column:
    number = F.regexp_extract(cwe, r"^CWE-(\d+)$", 1)
    slug = F.lower(F.replace(kind, F.lit("_"), F.lit("-")))
    return (
        F.when(F.size(refs) > 0, F.get(refs, F.lit(0)))
        .when(F.length(number) > 0, F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html")))
        .otherwise(F.concat(F.lit("https://owasp.org/www-community/attacks/"), slug))
    )


def sarif_rules(vulns: DataFrame) -> DataFrame:
    """Per scan and kind: texts of the first finding, worst level, finding sources, help address."""
    order = F.struct(*_order())
    out = vulns.groupBy(*KEYS, F.col("vulnerability_kind").alias("id")).agg(
        F.min_by(F.struct("title", "description", "remediation", "cwe"), order).alias("_f"), F.min(C.severity_rank()).alias("_rank"),
        F.array_sort(F.collect_set("finding_source")).alias("finding_sources"))
    human = F.initcap(F.replace("id", F.lit("_"), F.lit(" ")))
    return out.select(
        *KEYS, "id", human.alias("name"), F.col("_f.title").alias("short_description"), F.col("_f.description").alias("full_description"),
        help_uri(F.col("_f.cwe"), references(F.col("_f.cwe")), F.col("id")).alias("help_uri"), F.col("_f.remediation").alias("help"),
        sarif_level(F.col("_rank")).alias("level"), F.col("_f.cwe").alias("cwe"), "finding_sources")


def _place(line: Column, snippet: Column | None = None, chars: int | None = None) -> Column:
    region = [line.alias("startLine"), line.alias("endLine")]
    if snippet is not None:
        region.append(F.when(F.length(snippet) > 0, F.struct(C.short(snippet, chars).alias("text"))).alias("snippet"))
    uri = F.replace(F.coalesce("file", F.lit("")), F.lit("\\"), F.lit("/"))
    return F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(*region).alias("region"))


def sarif_results(vulns: DataFrame, snippet_chars: int | None = None) -> DataFrame:
    """(keys, vuln_id, sort columns, result): one SARIF result per finding."""
    sink, src = F.coalesce("sink_line", F.lit(0)), F.coalesce("line", F.lit(0))
    line = F.when(sink > 0, sink).when(src > 0, src).otherwise(1)
    text = lambda c, d: F.coalesce(F.when(F.length(c) > 0, F.col(c)), F.lit(d))
    related = F.array_compact(F.array(
        F.when((src > 0) & (src != line), F.struct(
            F.lit(1).alias("id"), _place(src).alias("physicalLocation"), F.struct(text("source_label", "Taint source").alias("text")).alias("message"))),
        F.when(sink > 0, F.struct(
            F.lit(2).alias("id"), _place(sink).alias("physicalLocation"), F.struct(text("sink_label", "Taint sink").alias("text")).alias("message")))))
    props = F.struct(
        F.col("vuln_id").alias("vulnId"), "severity", "confidence", F.col("finding_source").alias("findingSource"), "cwe",
        F.col("method_name").alias("method"), F.col("class_name").alias("class"), src.alias("sourceLine"), sink.alias("sinkLine"),
        F.col("source_label").alias("sourceLabel"), F.col("sink_label").alias("sinkLabel"), "remediation",
        F.slice(references(F.col("cwe")), 1, 5).alias("references"),
        F.struct(F.col("is_in_loop").alias("isInLoop"), F.col("has_partial_sanitizer").alias("hasPartialSanitizer"), F.col("is_entry_point").alias("isEntryPoint")).alias("context"))
    result = F.struct(
        F.col("vulnerability_kind").alias("ruleId"), sarif_level(C.severity_rank()).alias("level"), F.lit("fail").alias("kind"),
        F.struct(F.col("title").alias("text"), F.col("description").alias("markdown")).alias("message"),
        F.array(F.struct(_place(line, F.col("code_snippet"), snippet_chars).alias("physicalLocation"))).alias("locations"), related.alias("relatedLocations"), props.alias("properties"))
    return vulns.select(*KEYS, "vuln_id", C.severity_rank().alias("severity_rank"), "file", "sink_line", result.alias("result"))


def paged(rows: DataFrame, order: list[str | Column], page_rows: int = PAGE_ROWS) -> DataFrame:
    """Adds page (1-based) and position inside the scan."""
    return ranked(rows, KEYS, order, "position").withColumn("page", F.ceil(F.col("position") / page_rows).cast("int"))


def _pages(rows: DataFrame, item: Column, name: str) -> DataFrame:
    """One row per (scan, page) with the page's items in order; a page is bounded."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))), lambda x: x["item"])
    return rows.groupBy(*KEYS, "page").agg(listed.alias(name))


def report_documents(vulns: DataFrame, generated_at: str, page_rows: int = PAGE_ROWS, snippet_chars: int | None = None) -> DataFrame:
    """(keys, page, document): JSON report documents. A scan of at most `page_rows` findings has one;
    a larger one has numbered pages that share the header, so no finding is dropped and no value
    grows without bound."""
    rows = paged(vulns, _order(), page_rows)
    item = F.struct(
        "vuln_id", "finding_source", "vulnerability_kind", "severity", "confidence", "cwe",
        F.struct(F.col("cvss_score").alias("base_score"), F.col("vector").alias("vector_string")).alias("cvss"), "title", "description", "remediation",
        F.struct("file", C.basename("file").alias("file_short"), F.col("line").alias("source_line"), "sink_line", F.col("method_name").alias("method"),
                 F.col("class_name").alias("class")).alias("location"),
        C.short("code_snippet", snippet_chars).alias("code_snippet"), F.struct("source_label", "sink_label").alias("taint_flow"),
        F.struct("is_in_loop", "has_partial_sanitizer", "is_entry_point").alias("context"), references(F.col("cwe")).alias("references"))
    pages = _pages(rows, item, "vulnerabilities")
    head = scan_header(vulns)
    # kinds and files in the header are the short top lists
    kinds = top_kinds(vulns).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rn", "vulnerability_kind", "n"))).alias("top_kinds"))
    files = top_files(vulns).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rn", "file", "n"))).alias("top_files"))
    fixes = remediation_summary(vulns).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("vulnerability_kind", "n", "primary_remediation", "references"))).alias("remediation_summary"))
    full = pages.join(head, KEYS).join(kinds, KEYS, "left").join(files, KEYS, "left").join(fixes, KEYS, "left")
    doc = F.struct(
        F.lit("1.0").alias("schema_version"), "scan_id", F.lit(generated_at).alias("generated_at"), F.col("project_id").alias("project"), "page",
        F.ceil(F.col("total") / page_rows).cast("int").alias("page_count"),
        F.struct(F.col("total").alias("total_vulnerabilities"), *[s.lower() for s in C.SEVERITIES], "risk_level", "top_kinds", "top_files").alias("summary"),
        "vulnerabilities", "remediation_summary")
    return full.select(*KEYS, "page", doc.alias("document"))


def sarif_documents(vulns: DataFrame, tool: str = "taintgrid", version: str = "1.0", page_rows: int = PAGE_ROWS) -> DataFrame:
    """(keys, page, document): SARIF 2.1.0 logs, one run per (scan, page)."""
    rows = paged(sarif_results(vulns), ["severity_rank", "file", "sink_line", "vuln_id"], page_rows)
    pages = _pages(rows, F.col("result"), "results")
    rule = F.struct(
        "id", "name", F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
        F.struct(F.col("full_description").alias("text")).alias("fullDescription"), F.col("help_uri").alias("helpUri"),
        F.struct(F.col("help").alias("text")).alias("help"), F.struct("level").alias("defaultConfiguration"),
        F.struct("cwe", F.col("finding_sources").alias("findingSources")).alias("properties"))
    rules = sarif_rules(vulns).groupBy(*KEYS).agg(F.array_sort(F.collect_list(rule)).alias("rules"))  # one per kind
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.lit("https://github.com/").alias("informationUri"), "rules",
                      F.struct(F.col("project_id").alias("projectName")).alias("properties"))
    run = F.struct(
        F.struct(driver.alias("driver")).alias("tool"),
        F.array(F.struct(F.lit(True).alias("executionSuccessful"), F.struct(F.col("scan_id").alias("scanId"), "page").alias("properties"))).alias("invocations"),
        "results")
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return pages.join(rules, KEYS).select(*KEYS, "page", doc.alias("document"))
