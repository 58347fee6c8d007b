"""Review of findings by an outside scorer: which findings to send, as what text, and what its replies
change. The scorer is any function of the user's; replies are data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.session import KEYS, ranked, top_n

# --- fixed values -------------------------------------------------------------------------
REVIEWED = ["high", "medium"]
SINGLE = ["CRITICAL", "HIGH"]
BATCH = 5
REQUIRED_FIELDS = {
    "analysis": ["vulnerability_detected", "classification", "confidence"],
    "verdict": ["is_false_positive", "reasoning", "confidence_adjusted"],
    "rule": ["id", "rule_type", "symbol", "vulnerability", "description", "remediation"],
}
FIELDS = [
    "is_false_positive", "confidence_adjusted", "severity_adjusted", "reasoning", "enriched_description", "enriched_remediation", "suggested_fix",
]
# ------------------------------------------------------------------------------------------


def select_for_review(vulns: DataFrame, n: int | None = None) -> DataFrame:
    """The findings per scan worth a review, or the first n of them: high or medium confidence, not already doubtful.
    Adds `review_no`."""
    part = vulns.where(F.col("confidence").isin(*REVIEWED) & ~C.is_fp_candidate())
    order = [C.severity_rank(), C.confidence_rank(), F.col("line"), F.col("vuln_id")]
    if n is None:
        return ranked(part, KEYS, order, "review_no").withColumn("review_no", F.col("review_no").cast("int"))
    return top_n(part, KEYS, order, n, "review_no")


def route_review(selected: DataFrame, n: int = BATCH) -> DataFrame:
    """Adds route (single or batch), batch_no and index (1-based inside the batch)."""
    route = F.when(F.col("severity").isin(*SINGLE), "single").otherwise("batch")
    rows = ranked(selected.withColumn("route", route), [*KEYS, "route"], ["review_no"], "_rn")
    is_batch = F.col("route") == "batch"
    return rows.withColumn("batch_no", F.when(is_batch, F.ceil(F.col("_rn") / n)).otherwise(F.col("_rn")).cast("int")).withColumn(
        "index", F.when(is_batch, (F.col("_rn") - 1) % n + 1).otherwise(1).cast("int")).drop("_rn")


def method_context(nodes: DataFrame, n: int, text_chars: int | None = None) -> DataFrame:
    """(keys, method_id, context): the first n nodes by line with role marks, as one text."""
    mark = F.when(F.col("is_known_source"), "[SOURCE] ").when(F.col("is_known_sink"), "[SINK] ").when(F.col("is_known_sanitizer"), "[SANITIZER] ").otherwise("")
    line = F.concat(F.lit("L"), F.col("line"), F.lit(": "), mark, C.short("text", text_chars))
    part = nodes.where("containing_method_id is not null").select(*KEYS, F.col("containing_method_id").alias("method_id"), "line", "node_id", line.alias("t"))
    first = top_n(part, [*KEYS, "method_id"], [F.col("line"), F.col("node_id")], n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", "t"))), lambda x: x["t"])  # at most n
    return first.groupBy(*KEYS, "method_id").agg(F.array_join(listed, "\n").alias("context"))


def _na(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("N/A"))


SINGLE_REPLY = (
    'Answer with JSON only: {"is_false_positive": true|false, "reasoning": "...", "confidence_adjusted": "confirmed|high|medium|low"|null, '
    '"severity_adjusted": "CRITICAL|HIGH|MEDIUM|LOW|INFO"|null, "enriched_description": "...", "enriched_remediation": "...", "suggested_fix": "..."|null}'
)
BATCH_REPLY = 'Answer with JSON only: {"findings": [{"index": 1, "is_likely_fp": false, "reason": "..."}]}'
CHECK_REPLY = 'Answer with JSON only: {"is_false_positive": true|false, "reasoning": "...", "confidence_adjusted": "..."|null}'
RULE_REPLY = 'Answer with a JSON list of rules with id, rule_type, symbol, name, vulnerability, severity, cwe, cvss_base, description, remediation, frameworks, tags.'


def build_prompts(routed: DataFrame, contexts: DataFrame, primary: DataFrame | None = None) -> DataFrame:
    """(keys, route, batch_no, prompt, vuln_ids): one row per single finding and per batch."""
    rows = routed.join(contexts, [*KEYS, "method_id"], "left")
    if primary is not None:
        rows = rows.join(primary, KEYS, "left")
    else:
        rows = rows.withColumn("primary_framework", F.lit("generic"))
    where = F.concat(_na("class_name"), F.lit("."), _na("method_name"), F.lit("()"))
    single = F.concat_ws(
        "\n", F.lit("Review this finding in C# code."), F.concat(F.lit("Kind: "), "vulnerability_kind", F.lit(" ("), "cwe", F.lit(")")),
        F.concat(F.lit("Severity: "), "severity"), F.concat(F.lit("Confidence: "), "confidence"), F.concat(F.lit("Framework: "), _na("primary_framework")),
        F.concat(F.lit("Found by: "), "finding_source"), F.concat(F.lit("Place: "), C.basename("file"), F.lit(":"), "sink_line", F.lit(" in "), where),
        F.concat(F.lit("Source: "), _na("source_label")), F.concat(F.lit("Sink: "), F.coalesce("sink_label", "code_snippet")),
        F.concat(F.lit("Code:\n"), F.coalesce("context", "code_snippet", F.lit(""))),
        F.concat(F.lit("In a loop: "), F.col("is_in_loop").cast("string"), F.lit("; partial sanitizer: "), F.col("has_partial_sanitizer").cast("string"),
                 F.lit("; entry point: "), F.col("is_entry_point").cast("string")),
        F.lit(SINGLE_REPLY))
    item = F.concat(F.col("index").cast("string"), F.lit(". ["), F.col("vulnerability_kind"), F.lit("] "), where, F.lit(" L"), F.col("sink_line"), F.lit(": "), "code_snippet")
    ones = rows.where("route = 'single'").select(*KEYS, "route", "batch_no", single.alias("prompt"), F.array("vuln_id").alias("vuln_ids"))
    many = rows.where("route = 'batch'").select(*KEYS, "route", "batch_no", "index", "vuln_id", item.alias("item")).groupBy(*KEYS, "route", "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("index", "item", "vuln_id"))).alias("_i"))  # at most one batch
    text = F.concat_ws("\n", F.lit("Review these findings in C# code."), F.array_join(F.transform("_i", lambda x: x["item"]), "\n"), F.lit(BATCH_REPLY))
    return ones.unionByName(many.select(*KEYS, "route", "batch_no", text.alias("prompt"), F.transform("_i", lambda x: x["vuln_id"]).alias("vuln_ids")))


def check_prompts(vulns: DataFrame) -> DataFrame:
    """One short question per finding: real or not."""
    text = F.concat_ws("\n", F.lit("Is this finding a false positive?"), F.concat("vulnerability_kind", F.lit(" at "), C.basename("file"), F.lit(":"), "sink_line"), F.col("code_snippet"), F.lit(CHECK_REPLY))
    return vulns.select(*KEYS, "vuln_id", text.alias("prompt"))


def rule_prompts(descriptions: DataFrame) -> DataFrame:
    """`descriptions(id, description, rule_type, framework)` to prompts that ask for rules."""
    text = F.concat_ws("\n", F.lit("Write static-analysis rules for C#."), F.concat(F.lit("Type: "), _na("rule_type")), F.concat(F.lit("Framework: "), _na("framework")), F.concat(F.lit("Pattern: "), "description"), F.lit(RULE_REPLY))
    return descriptions.select("id", text.alias("prompt"))


def score(prompts: DataFrame, fn: Callable[[pd.Series], pd.Series], column: str = "prompt") -> DataFrame:
    """Adds `reply` by the user's function over batches of prompts. A batch that raises gets NULL
    replies and `score_error`, so its findings keep their state."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema)}, reply string, score_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                replies, error = list(fn(batch[column])), None
            except Exception as exc:  # noqa: BLE001  the scorer is foreign code
                replies, error = [None] * len(batch), str(exc)[:80]
            yield batch.assign(reply=replies, score_error=error)

    return prompts.mapInPandas(run, schema)


# --- replies ----------------------------------------------------------------------------


def clean_json(text: str | Column) -> Column:
    """The JSON of a reply: byte mark and code fence off, outermost brackets, line breaks to spaces
    (outside strings a line break means the same as a space)."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(F.trim(t), "^\ufeff+", "")
    fence = r"(?is)```(?:json)?\s*(.*?)\s*```"
    t = F.trim(F.when(t.rlike(fence), F.regexp_extract(t, fence, 1)).otherwise(t))
    big = F.lit(1 << 30)
    at = lambda ch: F.when(F.instr(t, ch) > 0, F.instr(t, ch)).otherwise(big)
    start = F.least(at("{"), at("["))
    t = F.when(start < big, F.substring(t, start, F.length(t))).otherwise(t)
    rev = F.reverse(t)
    back = F.least(
        F.when(F.instr(rev, "}") > 0, F.instr(rev, "}")).otherwise(big), F.when(F.instr(rev, "]") > 0, F.instr(rev, "]")).otherwise(big))
    t = F.when(back < big, F.substring(t, F.lit(1), F.length(t) - back + 1)).otherwise(t)
    return F.regexp_replace(t, r"[\r\n]", " ")


def _field(text: Column, name: str) -> Column:
    """A string field by pattern, also one cut off at the end."""
    closed = F.regexp_extract(text, rf'(?is)"{name}"\s*:\s*"((?:\\.|[^"\\])*)"\s*(?:,|\}})', 1)
    open_ = F.regexp_extract(text, rf'(?is)"{name}"\s*:\s*"((?:\\.|[^"\\])*)$', 1)
    raw = F.when(F.length(closed) > 0, closed).otherwise(open_)
    return F.when(F.length(raw) > 0, F.replace(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit(" ")))


def _flag(text: Column, name: str) -> Column:
    hit = F.lower(F.regexp_extract(text, rf'(?is)"{name}"\s*:\s*(true|false)', 1))
    return F.when(F.length(hit) > 0, hit == "true")


def _truth(text: Column) -> Column:
    return F.coalesce(~F.lower(text).isin("false", "0", "", "null", "[]", "{}"), F.lit(False))


def _one_of(text: Column, values: list[str], fold: Callable[[Column], Column]) -> Column:
    return F.when(fold(text).isin(*values), fold(text))


def parse_verdicts(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Adds the verdict fields and `verdict_source`: json, fields (pattern per field) or keep."""
    schema = ", ".join(f"{f} string" for f in FIELDS) + ", _bad string"
    clean = clean_json(column)
    df = replies.withColumn("_c", clean).withColumn("_j", F.from_json("_c", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.col("_j").isNotNull() & F.col("_j._bad").isNull() & F.col("_c").startswith("{")
    c = F.col("_c")
    loose_flag, loose_reason = _flag(c, "is_false_positive"), _field(c, "reasoning")
    partial = ~ok & loose_flag.isNotNull() & loose_reason.isNotNull()
    pick = lambda f: F.when(ok, F.col(f"_j.{f}")).when(partial, _field(c, f))
    return df.withColumns({
        "verdict_source": F.when(F.coalesce(ok, F.lit(False)), "json").when(F.coalesce(partial, F.lit(False)), "fields").otherwise("keep"),
        "is_false_positive": F.coalesce(F.when(ok, _truth(F.col("_j.is_false_positive"))).when(partial, loose_flag), F.lit(False)),
        "confidence_adjusted": _one_of(pick("confidence_adjusted"), C.CONFIDENCES, F.lower),
        "severity_adjusted": _one_of(pick("severity_adjusted"), C.SEVERITIES, F.upper),
        "reasoning": F.coalesce(pick("reasoning"), F.when(ok, F.lit("")), F.lit("reply not readable; kept as real")),
        "enriched_description": pick("enriched_description"), "enriched_remediation": pick("enriched_remediation"), "suggested_fix": pick("suggested_fix"),
    }).drop("_c", "_j")


def parse_batch(replies: DataFrame, routed: DataFrame, column: str = "reply") -> DataFrame:
    """(keys, vuln_id, is_false_positive, reasoning, verdict_source) of batch replies.

    Read as JSON, every finding of the batch gets a verdict, unanswered ones a keep verdict. Where
    only pieces can be read, the findings they name get one; where nothing can, all are kept.
    """
    item = "struct<index:int,is_likely_fp:string,reason:string>"
    df = replies.withColumn("_c", clean_json(column)).withColumn(
        "_j", F.from_json("_c", f"findings array<{item}>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    ok = F.coalesce(F.col("_j").isNotNull() & F.col("_j._bad").isNull() & F.col("_c").startswith("{"), F.lit(False))
    cuts = F.regexp_extract_all("_c", F.lit(r'(?is)(\{\s*"index"\s*:\s*\d+(?:(?!\{\s*"index").)*)'), F.lit(1))
    loose = F.transform(cuts, lambda t: F.struct(
        F.regexp_extract(t, r'(?is)"index"\s*:\s*(\d+)', 1).cast("int").alias("index"),
        F.regexp_extract(t, r'(?is)"is_likely_fp"\s*:\s*(true|false)', 1).alias("is_likely_fp"),
        F.coalesce(_field(t, "reason"), F.lit("partial reply")).alias("reason")))
    df = df.withColumn("_ok", ok).withColumn("_items", F.when(ok, F.coalesce("_j.findings", F.expr(f"cast(array() as array<{item}>)"))).otherwise(loose))
    df = df.withColumn("_mode", F.when(F.col("_ok"), "json").when(F.size("_items") > 0, "fields").otherwise("keep"))
    modes = df.select(*KEYS, "batch_no", "_mode")
    answers = df.select(*KEYS, "batch_no", F.explode("_items").alias("i")).groupBy(*KEYS, "batch_no", F.col("i.index").alias("index")).agg(
        F.min(F.struct("i.is_likely_fp", "i.reason")).alias("_a"))  # of two answers the smaller, whatever the task order
    asked = routed.where("route = 'batch'").select(*KEYS, "batch_no", "index", "vuln_id")
    out = asked.join(modes, [*KEYS, "batch_no"]).join(answers, [*KEYS, "batch_no", "index"], "left")
    out = out.where((F.col("_mode") != "fields") | F.col("_a").isNotNull())
    return out.select(
        *KEYS, "vuln_id", _truth(F.col("_a.is_likely_fp")).alias("is_false_positive"),
        F.coalesce("_a.reason", F.when(F.col("_a").isNotNull(), F.lit("")), F.lit("not answered; kept as real")).alias("reasoning"),
        F.when(F.col("_a").isNull(), "keep").otherwise(F.col("_mode")).alias("verdict_source"))


def reply_is_valid(kind: str = "verdict", column: str | Column = "reply") -> Column:
    """The reply is an object that has every required field."""
    keys = F.json_object_keys(F.col(column) if isinstance(column, str) else column)
    need = F.array(*[F.lit(f) for f in REQUIRED_FIELDS[kind]])
    return F.coalesce(F.size(F.array_except(need, keys)) == 0, F.lit(False))


# --- use of verdicts ----------------------------------------------------------------------


def apply_verdicts(vulns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings after review. A false-positive suggestion is only noted; any other verdict overrides
    the fields it fills. Adds is_reviewed, fp_suggested, review_reasoning, suggested_fix."""
    fields = ["is_false_positive", "confidence_adjusted", "severity_adjusted", "reasoning", "enriched_description", "enriched_remediation", "suggested_fix"]
    have = [F.col(f) if f in verdicts.columns else F.lit(None).cast("string").alias(f) for f in fields]
    v = verdicts.select(*KEYS, "vuln_id", F.struct(*have).alias("_v")).groupBy(*KEYS, "vuln_id").agg(F.min("_v").alias("_v"))  # of two verdicts the smaller
    j = vulns.join(v, [*KEYS, "vuln_id"], "left")
    seen = F.col("_v").isNotNull()
    doubt = F.coalesce(F.col("_v.is_false_positive"), F.lit(False))
    use = seen & ~doubt
    filled = lambda f: use & (F.length(F.col(f"_v.{f}")) > 0)
    return j.withColumns({
        "description": F.when(filled("enriched_description"), F.concat(F.col("description"), F.lit("\n\nReview: "), F.col("_v.enriched_description"))).otherwise(F.col("description")),
        "remediation": F.when(filled("enriched_remediation"), F.col("_v.enriched_remediation")).otherwise(F.col("remediation")),
        "confidence": F.when(use, F.coalesce("_v.confidence_adjusted", "confidence")).otherwise(F.col("confidence")),
        "severity": F.when(use, F.coalesce("_v.severity_adjusted", "severity")).otherwise(F.col("severity")),
        "is_reviewed": seen, "fp_suggested": doubt, "review_reasoning": F.col("_v.reasoning"),
        "suggested_fix": F.when(use, F.col("_v.suggested_fix")),
    }).drop("_v")


def review_stats(vulns: DataFrame, selected: DataFrame) -> DataFrame:
    """Per scan: analysed, confirmed, false positives removed (none ever), skipped, reduction in percent."""
    total = vulns.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("confirmed"))
    sent = selected.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("analyzed"))
    out = total.join(sent, KEYS, "left").na.fill(0, ["analyzed"]).withColumn("false_positives", F.lit(0).cast("long"))
    pct = F.when(F.col("analyzed") > 0, F.round(F.col("false_positives") / F.col("analyzed") * 100, 1)).otherwise(0.0)
    return out.withColumn("skipped", F.col("confirmed") - F.col("analyzed")).withColumn("reduction_pct", pct)
