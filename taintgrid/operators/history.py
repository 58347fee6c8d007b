"""Scan history over two tables: `scans`, one header row per scan, and `vulns`, one row per stored
finding (project_name, scan_id, vuln_id, vulnerability_kind, severity, …).

Findings are rows and not an array in the scan row, so one huge scan stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.session import top_n

P = ["project_name", "scan_id"]


def _by(given: DataFrame) -> list[str]:
    """What names a scan in a table given by the user: project and scan, or the scan alone where it has no project."""
    return [c for c in P if c in given.columns]


def _newest() -> list[Column]:
    return [F.col("scan_started_at").desc(), F.col("scan_id").desc()]


# --- store ------------------------------------------------------------------------------


def upsert_scans(store: DataFrame, updates: DataFrame, key: str = "scan_id", order: str = "updated_at") -> DataFrame:
    """The latest row per scan of store and updates."""
    both = store.unionByName(updates, allowMissingColumns=True)
    ties = F.xxhash64(*[c for c in both.columns if c != key])
    return top_n(both, [key], [F.col(order).desc_nulls_last(), ties], 1).drop("rn")


def write_scans(scans: DataFrame, path: str, by: str = "project_name") -> None:
    """Rewrite only the projects present in `scans`."""
    scans.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def complete_scans(scans: DataFrame, vulns: DataFrame, finished_at: str | Column, failed: DataFrame | None = None) -> DataFrame:
    """Running scans get their summary, duration and status: completed, or, for scans listed in
    `failed(scan_id, error)`, of several errors with the smallest text, partial when findings exist and failed when not."""
    end = F.lit(finished_at) if isinstance(finished_at, str) else finished_at
    done = scans.drop("total_vulns", "critical", "high", "medium", "low", "info").join(severity_summary(vulns), P, "left").na.fill(
        0, ["total_vulns", "critical", "high", "medium", "low", "info"])
    if failed is not None:
        done = done.join(failed.groupBy(*_by(failed)).agg(F.min("error").alias("error_message")), _by(failed), "left")
    else:
        done = done.withColumn("error_message", F.lit(None).cast("string"))
    status = F.when(F.col("error_message").isNull(), "completed").when(F.col("total_vulns") > 0, "partial").otherwise("failed")
    return done.withColumn("scan_status", F.when(F.col("scan_status") == "running", status).otherwise(F.col("scan_status"))).withColumn(
        "scan_duration_sec", C.duration_seconds("scan_started_at", end)).withColumn("updated_at", end.cast("string"))


def severity_summary(vulns: DataFrame) -> DataFrame:
    """Counts per scan."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in C.SEVERITIES]
    return vulns.groupBy(*P).agg(F.count(F.lit(1)).alias("total_vulns"), *counts)


def to_stored(vulns: DataFrame, snippet_chars: int | None = None, text_chars: int | None = None) -> DataFrame:
    """The stored shape of a finding, its texts whole or cut to so many characters; a missing id is made from
    file, line and cwe."""
    key = F.concat_ws(":", F.coalesce("file", F.lit("")), F.col("sink_line").cast("string"), F.coalesce("cwe", F.lit("")))
    vid = F.when(F.length("vuln_id") > 0, F.col("vuln_id")).otherwise(F.substring(F.sha2(key, 256), 1, 16))
    return vulns.select(
        F.col("project_id").alias("project_name"), "scan_id", vid.alias("vuln_id"), "vulnerability_kind", "severity", "confidence", "finding_source", "cwe",
        F.struct(F.col("cvss_score").alias("base_score"), F.col("vector").alias("vector_string")).alias("cvss"), F.col("cvss_score").alias("cvss_base"),
        "file", "line", "sink_line", C.short("code_snippet", snippet_chars).alias("code_snippet"), "method_name", "class_name", "title",
        C.short("description", text_chars).alias("description"), C.short("remediation", text_chars).alias("remediation"), "source_label", "sink_label", "is_in_loop",
        "has_partial_sanitizer", "is_entry_point")


# --- lookups ----------------------------------------------------------------------------


def get_scan(scans: DataFrame, scan_id: str) -> DataFrame:
    return scans.where(F.col("scan_id") == scan_id)


def count_scans(scans: DataFrame, condition: Column | None = None) -> DataFrame:
    part = scans if condition is None else scans.where(condition)
    return part.agg(F.count(F.lit(1)).alias("n"))


def latest_scan(scans: DataFrame, status: str | None = "completed") -> DataFrame:
    """The newest scan per project, of a status."""
    part = scans if status is None else scans.where(F.col("scan_status") == status)
    return top_n(part, ["project_name"], _newest(), 1).drop("rn")


def list_scans(scans: DataFrame, project: str | None = None, limit: int = 20, archived: bool = False, per_project: bool = False) -> DataFrame:
    """Newest scans; archived ones only on request."""
    part = scans if archived else scans.where("not coalesce(is_archived, false)")
    if project is not None:
        part = part.where(F.col("project_name") == project)
    if per_project:
        return top_n(part, ["project_name"], _newest(), limit)
    return part.orderBy(*_newest()).limit(limit)


def scans_with(scans: DataFrame, vulns: DataFrame, kind: str, severity: str | None = None, same_finding: bool = False) -> DataFrame:
    """Scans that hold a kind (and a severity: on any finding, or on the same one)."""
    kinds = vulns.where(F.col("vulnerability_kind") == kind)
    if severity and same_finding:
        return scans.join(kinds.where(F.col("severity") == severity).select(*P).distinct(), P, "left_semi")
    out = scans.join(kinds.select(*P).distinct(), P, "left_semi")
    if severity:
        out = out.join(vulns.where(F.col("severity") == severity).select(*P).distinct(), P, "left_semi")
    return out


def scan_vulns(vulns: DataFrame, scan_id: str, severity: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    out = vulns.where(F.col("scan_id") == scan_id)
    if severity:
        out = out.where(F.col("severity") == severity)
    if kind:
        out = out.where(F.col("vulnerability_kind") == kind)
    return out if limit is None else out.orderBy("vuln_id").limit(limit)


def projects(scans: DataFrame) -> DataFrame:
    return scans.select("project_name").distinct().orderBy("project_name")


def count_projects(scans: DataFrame) -> DataFrame:
    return scans.agg(F.countDistinct("project_name").alias("n_projects"))


# --- trend ------------------------------------------------------------------------------


def match_scans(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Distinct finding ids of two scans with status new / resolved / persistent."""
    b = before.select(*by, "vuln_id").distinct().withColumn("_b", F.lit(True))
    a = after.select(*by, "vuln_id").distinct().withColumn("_a", F.lit(True))
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "resolved").otherwise("persistent")
    return b.join(a, [*by, "vuln_id"], "full_outer").select(*by, "vuln_id", status.alias("status"))


def trend_pairs(scans: DataFrame, n: int = 2) -> DataFrame:
    """(project_name, scan_before, scan_after): oldest and newest of each project's last n completed
    scans; projects with fewer than two have none."""
    last = top_n(scans.where("scan_status = 'completed'"), ["project_name"], _newest(), n, "_rn")
    ends = last.groupBy("project_name").agg(
        F.max_by("scan_id", "_rn").alias("scan_before"), F.min_by("scan_id", "_rn").alias("scan_after"), F.count(F.lit(1)).alias("_n"))
    return ends.where("_n > 1").drop("_n")


def trend_between(scans: DataFrame, vulns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Totals, severity deltas and matched counts for every (project_name, scan_before, scan_after)."""
    cols = ["total_vulns", "critical", "high", "medium", "low"]
    head = scans.select(*P, "scan_started_at", *cols)
    side = lambda tag: [F.col(c).alias(f"{c}_{tag}") for c in ["scan_started_at", *cols]]
    b = head.select("project_name", F.col("scan_id").alias("scan_before"), *side("b"))
    a = head.select("project_name", F.col("scan_id").alias("scan_after"), *side("a"))
    found = trend_vulns(vulns, pairs)
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    counts = found.groupBy("project_name", "scan_before", "scan_after").agg(n("new"), n("resolved"), n("persistent"))
    out = pairs.join(b, ["project_name", "scan_before"]).join(a, ["project_name", "scan_after"]).join(
        counts, ["project_name", "scan_before", "scan_after"], "left").na.fill(0, ["n_new", "n_resolved", "n_persistent"])
    delta = [(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"{c}_delta") for c in cols[1:]]
    total = F.col("total_vulns_a") - F.col("total_vulns_b")
    return out.select(
        "project_name", "scan_before", "scan_after", F.col("total_vulns_b").alias("total_before"), F.col("total_vulns_a").alias("total_after"),
        total.alias("total_delta"), *delta, "n_new", "n_resolved", "n_persistent", (total < 0).alias("improved"), (total > 0).alias("worsened"))


def trend_vulns(vulns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(project_name, scan_before, scan_after, vuln_id, status) for every pair."""
    ids = vulns.select(*P, "vuln_id").distinct()
    b = pairs.join(ids.withColumnRenamed("scan_id", "scan_before"), ["project_name", "scan_before"])
    a = pairs.join(ids.withColumnRenamed("scan_id", "scan_after"), ["project_name", "scan_after"])
    return match_scans(b, a, ["project_name", "scan_before", "scan_after"])


def trend_lists(vulns: DataFrame, pairs: DataFrame, n_changed: int = 20, n_kept: int = 10) -> DataFrame:
    """The first ids per status, for display: at most 20 new, 20 resolved, 10 persistent."""
    ranked_ = top_n(trend_vulns(vulns, pairs), ["project_name", "scan_before", "scan_after", "status"], [F.col("vuln_id")], max(n_changed, n_kept))
    return ranked_.where(F.col("rn") <= F.when(F.col("status") == "persistent", n_kept).otherwise(n_changed))


def trend(scans: DataFrame, vulns: DataFrame, n: int = 2) -> DataFrame:
    return trend_between(scans, vulns, trend_pairs(scans, n))


# --- gate -------------------------------------------------------------------------------


def gate(scans: DataFrame, vulns: DataFrame, fail_on: str = "HIGH", max_vulns: int | None = None) -> DataFrame:
    """Per scan: blocking findings, whether it passes, exit codes of the gate and of the console."""
    level = C.SEVERITIES.index(fail_on) if fail_on in C.SEVERITIES else 1
    block = vulns.where(C.severity_rank() <= level).groupBy(*P).agg(F.count(F.lit(1)).alias("blocking_count"))
    over = F.lit(False) if max_vulns is None else F.col("total_vulns") > max_vulns
    return scans.select(*P, "total_vulns").join(block, P, "left").na.fill(0, ["blocking_count"]).withColumn(
        "passes_gate", (F.col("blocking_count") == 0) & ~over).withColumn(
        "exit_code", F.when(F.col("passes_gate"), 0).otherwise(1)).withColumn(
        "console_exit_code", F.when(F.col("passes_gate") & (F.col("total_vulns") <= 0), 0).otherwise(1))


def gate_for(scans: DataFrame, vulns: DataFrame, wanted: DataFrame, fail_on: str = "HIGH", max_vulns: int | None = None) -> DataFrame:
    """Gate answers for asked scan ids; an unknown id fails."""
    known = gate(scans, vulns, fail_on, max_vulns)
    out = wanted.select("scan_id").join(known, "scan_id", "left")
    return out.withColumn("passes_gate", F.coalesce("passes_gate", F.lit(False))).na.fill(0, ["blocking_count", "total_vulns"]).na.fill(
        1, ["exit_code", "console_exit_code"]).na.fill("unknown", ["project_name"])


def blocking_list(vulns: DataFrame, fail_on: str = "HIGH", n: int = 20) -> DataFrame:
    """The first n blocking findings per scan, for display."""
    level = C.SEVERITIES.index(fail_on) if fail_on in C.SEVERITIES else 1
    return top_n(vulns.where(C.severity_rank() <= level), P, [C.severity_rank(), F.col("vuln_id")], n)


# --- changes ----------------------------------------------------------------------------


def archive(scans: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select(*_by(ids)).distinct().withColumn("_hit", F.lit(True))
    return scans.join(hit, _by(ids), "left").withColumn(
        "is_archived", F.coalesce("is_archived", F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_hit").select(*scans.columns)


def add_tags(scans: DataFrame, tags: DataFrame) -> DataFrame:
    """`tags(scan_id, tags)`: added as a set, in order of first use; several lists of a scan in their sort order."""
    t = tags.groupBy(*_by(tags)).agg(F.array_distinct(F.flatten(F.array_sort(F.collect_list("tags")))).alias("_more"))
    none = F.expr("cast(array() as array<string>)")
    return scans.join(t, _by(tags), "left").withColumn(
        "tags", F.array_union(F.coalesce("tags", none), F.coalesce("_more", none))).drop("_more").select(*scans.columns)


def progress(updates: DataFrame, message_chars: int | None = None) -> DataFrame:
    """The last state of each scan from `updates(scan_id, updated_at, status, message)`; of equal times the
    largest status and message. Messages are whole unless a length is given."""
    last = F.max(F.struct("updated_at", "status", "message")).alias("_u")
    return updates.groupBy("scan_id").agg(last).select("scan_id", "_u.status", C.short("_u.message", message_chars).alias("message"), "_u.updated_at")


def delete_scans(scans: DataFrame, ids: DataFrame) -> DataFrame:
    return scans.join(ids.select(*_by(ids)).distinct(), _by(ids), "left_anti").select(*scans.columns)


def retain(scans: DataFrame, n: int = 10) -> DataFrame:
    """The newest n scans of each project."""
    return top_n(scans, ["project_name"], _newest(), n).drop("rn")


# --- statistics -------------------------------------------------------------------------


def scan_stats(scans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals by status, averages and severity sums over completed scans, per project or overall."""
    by = ["project_name"] if by is None else by
    done = F.col("scan_status") == "completed"
    of = lambda c: F.when(done, F.col(c))
    total = lambda c: F.coalesce(F.sum(of(c)), F.lit(0)).cast("long").alias(c)
    return scans.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_scans"), F.count_if(done).alias("completed_scans"), F.count_if(F.col("scan_status") == "failed").alias("failed_scans"),
        F.round(F.coalesce(F.avg(of("total_vulns")), F.lit(0.0)), 1).alias("avg_vulns_per_scan"),
        F.coalesce(F.sum(of("total_vulns")), F.lit(0)).cast("long").alias("total_vulns_found"),
        F.round(F.coalesce(F.avg(of("scan_duration_sec")), F.lit(0.0)), 1).alias("avg_scan_duration"),
        F.min(of("scan_started_at")).alias("first_scan_at"), F.max(of("scan_started_at")).alias("last_scan_at"),
        *[total(s.lower()) for s in C.SEVERITIES])


def kind_counts(scans: DataFrame, vulns: DataFrame, n: int = 15, by: list[str] | None = None) -> DataFrame:
    """The n most frequent kinds in completed scans, per project or overall."""
    by = ["project_name"] if by is None else by
    done = scans.where("scan_status = 'completed'").select(*P)
    counts = vulns.join(done, P, "left_semi").groupBy(*by, "vulnerability_kind").agg(F.count(F.lit(1)).alias("n"))
    return top_n(counts, by, [F.col("n").desc(), F.col("vulnerability_kind")], n)


def framework_counts(scans: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scans.where("framework is not null").groupBy(*(["project_name"] if by is None else by), "framework").agg(F.count(F.lit(1)).alias("n"))
