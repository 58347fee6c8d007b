"""Rule catalogue filters, validation, ids, and the governed rule store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.functions import columns as C
from taintgrid.session import one_per, ranked, top_n

# --- fixed values -------------------------------------------------------------------------
KIND_NAMES = """
SQL_INJECTION COMMAND_INJECTION PATH_TRAVERSAL XXE INSECURE_DESERIALIZATION SSRF REFLECTION_ABUSE RAZOR_XSS XSS
LOG_INJECTION OPEN_REDIRECT CSRF
""".split()
RULE_TYPES = ["sink", "source", "sanitizer"]
LABELS = ["USER_INPUT", "EXTERNAL_INPUT", "NETWORK_INPUT", "STORED_INPUT", "ENVIRONMENT_INPUT"]
SANITIZER_TYPES = ["ENCODING", "VALIDATION", "PARAMETERIZATION"]
FRAMEWORKS = ["generic", "aspnetcore", "aspnet_mvc", "wcf", "winforms", "console", "ef_core", "ef6", "dapper", "grpc", "signalr"]
DATA_FORMATS = ["string", "bytes", "stream", "object"]
ID_PREFIXES = {
    "SQL_INJECTION": "GEN-SQL", "COMMAND_INJECTION": "GEN-CMD", "PATH_TRAVERSAL": "GEN-PATH", "XXE": "GEN-XXE",
    "INSECURE_DESERIALIZATION": "GEN-DESER", "SSRF": "GEN-SSRF", "REFLECTION_ABUSE": "GEN-REFLECT", "RAZOR_XSS": "GEN-XSS",
    "XSS": "GEN-XSS", "LOG_INJECTION": "GEN-LOG", "OPEN_REDIRECT": "GEN-REDIRECT", "CSRF": "GEN-CSRF",
}
TEXT_CONFIDENCE = {"confirmed": 0.98, "high": 0.90, "medium": 0.75, "low": 0.60}
WRITE_TAGS = ["write", "append", "create", "upload"]
TYPE_TAGS = ["integer", "long", "guid", "uuid", "double", "decimal", "boolean", "datetime", "datetimeoffset", "timespan", "ipaddress"]
# ------------------------------------------------------------------------------------------


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def _no_items(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) <= 0


def _items(array: str) -> Column:
    return F.coalesce(F.col(array), F.expr("cast(array() as array<string>)"))


# --- catalogue ----------------------------------------------------------------------------


def with_custom_rules(rules: DataFrame, custom: DataFrame) -> DataFrame:
    """Catalogue plus user rules. On equal id a user rule replaces a built-in one, a repeated
    built-in keeps the last, a repeated user rule the first. Rules without id get one from their
    content."""
    both = rules.withColumn("is_custom", F.lit(False)).unionByName(custom.withColumn("is_custom", F.lit(True)), allowMissingColumns=True)
    made = F.concat(F.lit("auto-"), F.substring(F.sha2(F.concat_ws("|", "rule_type", "symbol", "vulnerability", "taint_label"), 256), 1, 12))
    both = both.withColumn("id", F.when(_blank("id"), made).otherwise(F.col("id")))
    order = [F.col("is_custom").desc(), F.when(F.col("is_custom"), F.col("ordinal")).otherwise(-F.col("ordinal")), F.col("symbol")]
    return top_n(both, ["id"], order, 1).drop("rn")


def filter_framework(rules: DataFrame, active: list[str]) -> DataFrame:
    return rules.where(C.has_any("frameworks", ["generic", *active]))


def query_rules(
    rules: DataFrame, rule_type: str | None = None, vulnerability: str | None = None, rule_id: str | None = None, tag: str | None = None,
    severity: str | None = None, label: str | None = None, context: str | None = None, sanitizes: str | None = None,
    sanitizer_type: str | None = None, min_confidence: float | None = None, min_multiplier: float | None = None, authentication: str | None = None,
    framework: str | None = None, always_vulnerable: bool | None = None, any_tag: list[str] | None = None,
) -> DataFrame:
    """Rules that meet every condition given."""
    tests = {
        "rule_type": (rule_type, lambda v: F.col("rule_type") == v), "vulnerability": (vulnerability, lambda v: F.col("vulnerability") == v),
        "id": (rule_id, lambda v: F.col("id") == v), "tag": (tag, lambda v: F.array_contains(_items("tags"), v)),
        "severity": (severity, lambda v: F.col("severity") == v.upper()), "label": (label, lambda v: F.col("taint_label") == v),
        "context": (context, lambda v: F.array_contains(_items("encoding_context"), v)),
        "sanitizes": (sanitizes, lambda v: F.array_contains(_items("sanitizes"), v)),
        "sanitizer_type": (sanitizer_type, lambda v: F.col("sanitizer_type") == v),
        "min_confidence": (min_confidence, lambda v: F.col("confidence_score") >= v),
        "min_multiplier": (min_multiplier, lambda v: F.coalesce("severity_multiplier", F.lit(1.0)) >= v),
        "authentication": (authentication, lambda v: F.col("authentication_context") == v),
        "framework": (framework, lambda v: C.has_any("frameworks", [v, "generic"])),
        "always": (always_vulnerable, lambda v: F.coalesce("always_vulnerable", F.lit(False)) == v),
        "any_tag": (any_tag, lambda v: C.has_any("tags", v)),
    }
    for value, test in tests.values():
        if value is not None:
            rules = rules.where(test(value))
    return rules


def named_rule_sets() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Ready-made selections."""
    has = lambda t: F.array_contains(_items("tags"), t)
    src = F.col("rule_type") == "source"
    return {
        "write_sinks": lambda r: query_rules(r, "sink", "PATH_TRAVERSAL", any_tag=WRITE_TAGS),
        "network_sources": lambda r: r.where(src & ((F.col("taint_label") == "NETWORK_INPUT") | has("network"))),
        "second_order_sources": lambda r: r.where(src & ((F.col("taint_label") == "STORED_INPUT") | has("second-order"))),
        "messaging_sources": lambda r: query_rules(r, "source", any_tag=["messaging", "queue"]),
        "environment_sources": lambda r: query_rules(r, "source", label="ENVIRONMENT_INPUT"),
        "upload_sources": lambda r: query_rules(r, "source", tag="upload"),
        "unauthenticated_sources": lambda r: query_rules(r, "source", authentication="any"),
        "high_multiplier_sources": lambda r: query_rules(r, "source", min_multiplier=1.0),
        "html_sanitizers": lambda r: r.where(C.has_any("encoding_context", ["html_body", "html_attribute"])),
        "script_sanitizers": lambda r: query_rules(r, "sanitizer", context="javascript_string"),
        "high_confidence_sanitizers": lambda r: query_rules(r, "sanitizer", min_confidence=0.90),
        "type_conversions": lambda r: query_rules(r, "sanitizer", sanitizer_type="VALIDATION", any_tag=TYPE_TAGS),
        "linq_sanitizers": lambda r: query_rules(r, "sanitizer", tag="linq"),
        "url_validators": lambda r: r.where((F.col("sanitizer_type") == "VALIDATION") & C.has_any("sanitizes", ["SSRF", "OPEN_REDIRECT"])),
        "always_vulnerable_sinks": lambda r: query_rules(r, "sink", always_vulnerable=True),
    }


def _texts(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), text) for cond, text in pairs]))


def validate_catalog(rules: DataFrame) -> DataFrame:
    """Adds `errors`, the load-time faults; a rule without any is usable."""
    t = F.col("rule_type")
    missing = lambda kind, col: ((t == kind) & _blank(col), f"missing {col}")
    return rules.withColumn("errors", _texts(
        (_blank("rule_type") | ~t.isin(*RULE_TYPES), "unknown rule_type"), (_blank("id"), "missing id"), (_blank("symbol"), "missing symbol"),
        missing("sink", "vulnerability"), missing("sink", "cwe"), missing("source", "taint_label"),
        ((t == "sanitizer") & F.col("sanitizes").isNull(), "missing sanitizes"), ((t == "sanitizer") & F.col("confidence_score").isNull(), "missing confidence"),
        ((t == "sanitizer") & ~F.col("confidence_score").between(0.0, 1.0), "confidence out of range")))


def rule_maps(rules: DataFrame) -> DataFrame:
    """(rule_type, symbol, ordinal, taint_label, severity_multiplier, confidence_score, sanitizes): the last
    rule of a symbol wins."""
    last = lambda c: F.max_by(c, "ordinal").alias(c)
    use = rules.where("rule_type in ('source', 'sanitizer')")
    return use.withColumn("taint_label", F.when(F.col("rule_type") == "source", F.coalesce("taint_label", F.lit("USER_INPUT")))).withColumn(
        "severity_multiplier", F.when(F.col("rule_type") == "source", F.coalesce("severity_multiplier", F.lit(1.0)))).groupBy("rule_type", "symbol").agg(
        F.min("ordinal").alias("ordinal"), last("taint_label"), last("severity_multiplier"), last("confidence_score"), last("sanitizes"))


def load_stats(rules: DataFrame) -> DataFrame:
    """(dimension, value, n): totals by type, kind, label, sanitizer type."""
    rows = F.array_compact(F.array(
        F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")), F.struct(F.lit("rule_type").alias("dimension"), F.col("rule_type").alias("value")),
        F.when(F.col("vulnerability").isNotNull(), F.struct(F.lit("vulnerability").alias("dimension"), F.col("vulnerability").alias("value"))),
        F.when(F.col("taint_label").isNotNull(), F.struct(F.lit("taint_label").alias("dimension"), F.col("taint_label").alias("value"))),
        F.when(F.col("sanitizer_type").isNotNull(), F.struct(F.lit("sanitizer_type").alias("dimension"), F.col("sanitizer_type").alias("value")))))
    return rules.select(F.explode(rows).alias("r")).groupBy("r.dimension", "r.value").agg(F.count(F.lit(1)).alias("n"))


# --- new rules ----------------------------------------------------------------------------


def validate_rules(rules: DataFrame) -> DataFrame:
    """Adds errors, warnings, fixes and is_valid, and applies the fixes.

    A rule of unknown type is judged on its head fields alone.
    """
    t = F.col("rule_type")
    known = t.isin(*RULE_TYPES)
    sink, source, san = t == "sink", t == "source", t == "sanitizer"
    level = F.lower(F.col("confidence_level"))
    errors = _texts(
        (_blank("id"), "missing id"), (_blank("rule_type"), "missing rule_type"), (_blank("symbol"), "missing symbol"),
        (~_blank("rule_type") & ~known, "unknown rule_type"),
        (sink & _blank("vulnerability"), "missing vulnerability"), (sink & ~_blank("vulnerability") & ~F.col("vulnerability").isin(*KIND_NAMES), "unknown vulnerability"),
        (sink & ~_blank("severity") & ~F.col("severity").isin(*C.SEVERITIES), "unknown severity"),
        (sink & ~F.col("cvss_base").between(0.0, 10.0), "cvss_base out of range"),
        (source & _blank("taint_label"), "missing taint_label"), (source & ~_blank("taint_label") & ~F.col("taint_label").isin(*LABELS), "unknown taint_label"),
        (san & _no_items("sanitizes"), "missing sanitizes"),
        (san & ~_no_items("sanitizes") & (F.size(F.array_except(_items("sanitizes"), F.array(*[F.lit(k) for k in KIND_NAMES]))) > 0), "unknown kind in sanitizes"),
        (san & ~_blank("sanitizer_type") & ~F.col("sanitizer_type").isin(*SANITIZER_TYPES), "unknown sanitizer_type"),
        (san & F.col("confidence_score").isNull() & _blank("confidence_level"), "missing confidence"),
        (san & ~F.col("confidence_score").between(0.0, 1.0), "confidence out of range"),
    )
    dotted = F.col("symbol").contains(".")
    warnings = _texts(
        (_blank("name"), "empty name"), (_blank("description"), "empty description"),
        (sink & F.col("tainted_args").isNull(), "no tainted_args"), (sink & F.col("always_vulnerable").isNull(), "no always_vulnerable"),
        (sink & _blank("confidence_level"), "no confidence"), (sink & ~_blank("confidence_level") & ~level.isin(*C.CONFIDENCES), "unknown confidence"),
        (sink & _blank("severity"), "no severity"), (sink & _blank("cwe"), "no cwe"), (sink & ~_blank("cwe") & ~F.col("cwe").startswith("CWE-"), "odd cwe"),
        (sink & F.col("cvss_base").isNull(), "no cvss_base"), (sink & _blank("remediation"), "no remediation"),
        (source & F.col("severity_multiplier").isNull(), "no severity_multiplier"), (source & ~F.col("severity_multiplier").between(0.0, 2.0), "odd severity_multiplier"),
        (source & _blank("data_format"), "no data_format"), (source & ~_blank("data_format") & ~F.col("data_format").isin(*DATA_FORMATS), "odd data_format"),
        (source & ~_blank("authentication_context") & ~F.col("authentication_context").isin("any", "authenticated"), "odd authentication_context"),
        (san & _blank("sanitizer_type"), "no sanitizer_type"), (san & F.col("confidence_score").isNull() & ~_blank("confidence_level"), "text confidence"),
        (san & _no_items("encoding_context"), "no encoding_context"), (san & _blank("limitations"), "no limitations"),
        (known & _no_items("frameworks"), "no frameworks"),
        (known & ~_no_items("frameworks") & (F.size(F.array_except(_items("frameworks"), F.array(*[F.lit(f) for f in FRAMEWORKS]))) > 0), "unknown framework"),
        (known & _no_items("tags"), "no tags"), (known & ~_blank("symbol") & ~dotted, "undotted symbol"),
    )
    from_text = F.lit(None).cast("double")
    for name, score in TEXT_CONFIDENCE.items():
        from_text = F.when(level == name, score).otherwise(from_text)
    mapped = san & F.col("confidence_score").isNull() & from_text.isNotNull()
    fixes = _texts(
        (source & F.col("severity_multiplier").isNull(), "severity_multiplier=1.0"), (source & F.col("implicit").isNull(), "implicit=false"),
        (source & _blank("authentication_context"), "authentication_context=any"), (mapped, "confidence from text"))
    out = rules.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("fixes", fixes)
    return out.withColumns({
        "is_valid": F.size("errors") == 0,
        "severity_multiplier": F.when(source, F.coalesce("severity_multiplier", F.lit(1.0))).otherwise(F.col("severity_multiplier")),
        "implicit": F.when(source, F.coalesce("implicit", F.lit(False))).otherwise(F.col("implicit")),
        "authentication_context": F.when(source & _blank("authentication_context"), "any").otherwise(F.col("authentication_context")),
        "confidence_score": F.when(mapped, from_text).otherwise(F.col("confidence_score")),
    })


def id_prefix() -> Column:
    out = F.lit("GEN-SINK")
    for kind, prefix in ID_PREFIXES.items():
        out = F.when(F.col("vulnerability") == kind, prefix).otherwise(out)
    return F.when(F.col("rule_type") == "sink", out).when(F.col("rule_type") == "source", "GEN-SRC").otherwise("GEN-SAN")


def assign_ids(new: DataFrame, existing: DataFrame, order: str = "ordinal") -> DataFrame:
    """Unique ids for new rules. A new, well-formed id is kept by its first user; any other rule gets its
    prefix and the next numbers after the highest one in use, in rule order."""
    used = existing.where("length(id) > 0").select("id").distinct()
    form = F.col("id").startswith("GEN-") | (F.col("id").contains("-") & (F.length("id") < 30))
    fresh = new.join(used.withColumn("_used", F.lit(True)), "id", "left")
    ok = F.coalesce(form, F.lit(False)) & F.col("_used").isNull()
    firsts = fresh.where(ok).groupBy("id").agg(F.min(order).alias("_first"))
    marked = fresh.join(firsts, "id", "left").withColumn("_keep", F.coalesce(ok & (F.col(order) == F.col("_first")), F.lit(False))).drop("_used", "_first")
    kept = marked.where("_keep").drop("_keep").withColumn("assigned_id", F.col("id"))
    taken = used.union(kept.select(F.col("assigned_id").alias("id")))
    number = taken.select(F.regexp_extract("id", r"^(.+-.+)-(\d+)$", 1).alias("prefix"), F.regexp_extract("id", r"-(\d{1,9})$", 1).cast("int").alias("_n"))
    top = number.where("length(prefix) > 0").groupBy("prefix").agg(F.max("_n").alias("_top"))
    rest = marked.where("not _keep").drop("_keep").withColumn("prefix", id_prefix())
    counted = ranked(rest, ["prefix"], [order], "_rn").join(top, "prefix", "left")
    made = F.concat(F.col("prefix"), F.lit("-"), F.lpad((F.coalesce("_top", F.lit(0)) + F.col("_rn")).cast("string"), 3, "0"))
    # lpad would cut numbers above 999
    n = F.coalesce("_top", F.lit(0)) + F.col("_rn")
    made = F.when(n < 1000, made).otherwise(F.concat(F.col("prefix"), F.lit("-"), n.cast("string")))
    return kept.unionByName(counted.withColumn("assigned_id", made).select(*kept.columns))


def collisions(new: DataFrame, existing: DataFrame, head: int | None = None) -> DataFrame:
    """(new_id, existing_symbol, kind): equal symbols, and existing symbols that start with a new one longer
    than 20 characters, or with its first `head` characters if given."""
    n = new.where("length(symbol) > 0").select(F.col("id").alias("new_id"), "symbol")
    e = existing.where("length(symbol) > 0").select(F.col("symbol").alias("existing_symbol")).distinct()
    exact = n.join(e, n.symbol == e.existing_symbol).select("new_id", "existing_symbol", F.lit("exact").alias("kind"))
    heads = n.where(F.length("symbol") > 20).withColumn("_head", C.short("symbol", head))
    lengths = [r[0] for r in heads.select(F.length("_head")).distinct().orderBy(1).collect()]
    if not lengths:
        return exact
    fits = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length("existing_symbol"))
    cut = e.withColumn("_n", F.explode(fits)).select("existing_symbol", F.expr("substring(existing_symbol, 1, _n)").alias("_head"))
    similar = heads.join(cut, "_head").where("symbol <> existing_symbol").select("new_id", "existing_symbol", F.lit("similar").alias("kind"))
    return exact.unionByName(similar.distinct())


def ai_confidence() -> Column:
    """Score of a generated rule from its faults."""
    one = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    score = (
        1.0 - 0.15 * F.size("errors") - 0.05 * F.size("warnings") - one(~_blank("symbol") & ~F.col("symbol").contains("."), 0.20)
        - one(F.length(F.coalesce("description", F.lit(""))) < 30, 0.10) - one((F.col("rule_type") == "sink") & _blank("remediation"), 0.10)
    )
    return F.greatest(F.lit(0.0), F.round(score, 2))


def readiness(rules: DataFrame, found: DataFrame) -> DataFrame:
    """Validated rules plus n_collisions, confidence_ai and production_ready."""
    n = found.groupBy(F.col("new_id").alias("id")).agg(F.count(F.lit(1)).alias("n_collisions"))
    return rules.join(n, "id", "left").na.fill(0, ["n_collisions"]).withColumn("confidence_ai", ai_confidence()).withColumn(
        "production_ready", F.col("is_valid") & (F.col("n_collisions") == 0))


def generation_summary(ready: DataFrame) -> DataFrame:
    return ready.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"),
        F.count_if(F.col("n_collisions") > 0).alias("colliding"), F.count_if("production_ready").alias("ready"))


def extract_rules(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Rules in a reply: a list, the first list under `rules`, `generated_rules`, `sink_rules` or
    `items`, or one rule. One row per rule with its JSON text."""
    c = F.col(column)
    texts = "array<string>"
    found = F.coalesce(
        F.when(F.trim(c).startswith("["), F.from_json(c, texts)),
        *[F.from_json(F.get_json_object(c, f"$.{k}"), texts) for k in ("rules", "generated_rules", "sink_rules", "items")],
        F.when(F.get_json_object(c, "$.rule_type").isNotNull() | F.get_json_object(c, "$.symbol").isNotNull(), F.array(c)),
        F.expr("cast(array() as array<string>)"))
    rest = [x for x in replies.columns if x != column]
    return replies.select(*rest, F.posexplode(found).alias("rule_no", "rule_json"))


# --- store ------------------------------------------------------------------------------


def upsert_rules(store: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Insert rules, or replace the payload of a known id and raise its version. Review state stays.

    store: rule_id, rule_type, vulnerability, symbol, name, description, frameworks, payload,
    confidence_ai, production_ready, review_status, reviewed_by, reviewed_at, review_notes, version,
    created_at, updated_at.
    """
    payload = [c for c in new.columns if c != "rule_id"]
    n = one_per(new, ["rule_id"]).select("rule_id", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in payload])
    j = store.join(n, "rule_id", "full_outer")
    hit, fresh = F.coalesce("_new", F.lit(False)), F.col("version").isNull()
    cols = []
    for c in store.columns:
        if c in payload:
            cols.append(F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "version":
            cols.append(F.when(fresh, 1).when(hit, F.col(c) + 1).otherwise(F.col(c)).cast("int").alias(c))
        elif c == "created_at":
            cols.append(F.coalesce(c, F.lit(now)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, F.lit(now)).otherwise(F.col(c)).alias(c))
        elif c == "review_status":
            cols.append(F.coalesce(c, F.lit("pending")).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def insert_rules(store: DataFrame, new: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(store, refused): manual inserts do not replace a known id."""
    ids = store.select("rule_id").distinct()
    return upsert_rules(store, new.join(ids, "rule_id", "left_anti").select(*new.columns), now), new.join(ids, "rule_id", "left_semi")


def review_rules(store: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """`decisions(rule_id, decision, reviewer, notes)`: approved, rejected or pending (a reset)."""
    d = one_per(decisions, ["rule_id"]).select("rule_id", F.col("decision").alias("_d"), F.col("reviewer").alias("_r"), F.col("notes").alias("_n"))
    j = store.join(d, "rule_id", "left")
    hit, reset = F.col("_d").isNotNull(), F.col("_d") == "pending"
    return j.withColumns({
        "review_status": F.coalesce("_d", "review_status"),
        "reviewed_by": F.when(reset, F.lit(None)).when(hit, F.col("_r")).otherwise(F.col("reviewed_by")),
        "reviewed_at": F.when(reset, F.lit(None)).when(hit, F.lit(now)).otherwise(F.col("reviewed_at")),
        "review_notes": F.when(reset, F.lit(None)).when(hit, F.col("_n")).otherwise(F.col("review_notes")),
        "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")),
    }).select(*store.columns)


def query_store(
    store: DataFrame, rule_id: str | None = None, vulnerability: str | None = None, rule_type: str | None = None, framework: str | None = None,
    ready: bool | None = None, status: str | None = None, recent: int | None = None,
) -> DataFrame:
    """Stored rules by the conditions given, best AI confidence first; or the n most recent."""
    for name, value in (("rule_id", rule_id), ("vulnerability", vulnerability), ("rule_type", rule_type), ("production_ready", ready), ("review_status", status)):
        if value is not None:
            store = store.where(F.col(name) == value)
    if framework is not None:
        store = store.where(F.array_contains(_items("frameworks"), framework))
    if recent is not None:
        return store.orderBy(F.col("created_at").desc(), "rule_id").limit(recent)
    return store.orderBy(F.col("confidence_ai").desc(), "rule_id")


def store_values(store: DataFrame, column: str) -> DataFrame:
    """Distinct symbols or ids."""
    return store.select(column).where(F.col(column).isNotNull()).distinct()


def search_rules(store: DataFrame, query: str, n: int = 20) -> DataFrame:
    """The n best rules by matched words of name and description; rules without such a word still
    match when name, description or symbol contains the whole query."""
    words = [w for w in query.lower().split() if w]
    tokens = F.split(F.lower(F.concat_ws(" ", "name", "description")), r"\W+")
    score = F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]))) if words else F.lit(0)
    whole = F.lower(F.concat_ws("\n", "name", "description", "symbol")).contains(query.lower())
    return store.withColumn("score", score).where((F.col("score") > 0) | whole).orderBy(F.col("score").desc(), "rule_id").limit(n)


def delete_rules(store: DataFrame, ids: DataFrame | None = None, rejected: bool = False) -> DataFrame:
    if rejected:
        store = store.where("coalesce(review_status, '') <> 'rejected'")
    return store if ids is None else store.join(ids.select("rule_id").distinct(), "rule_id", "left_anti").select(*store.columns)


def rule_stats(store: DataFrame, top: int = 10) -> DataFrame:
    """(dimension, value, n): totals, by type, sinks by kind, the `top` frameworks, average confidence
    in thousandths."""
    total = store.groupBy(F.lit("total").alias("dimension"), F.lit("").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    types = store.groupBy(F.lit("rule_type").alias("dimension"), F.col("rule_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    kinds = store.where("rule_type = 'sink'").groupBy(F.lit("sink_kind").alias("dimension"), F.col("vulnerability").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    per = store.select(F.explode("frameworks").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    fws = per.orderBy(F.col("n").desc(), "value").limit(top).select(F.lit("framework").alias("dimension"), "value", "n")
    avg = store.agg(F.round(F.avg("confidence_ai") * 1000).cast("long").alias("n")).select(
        F.lit("avg_confidence").alias("dimension"), F.lit("").alias("value"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return total.unionByName(types).unionByName(kinds).unionByName(fws).unionByName(avg)


def export_rules(store: DataFrame, only_approved: bool = True) -> DataFrame:
    """Payloads the engine may load: ready rules, approved unless told otherwise, best first."""
    out = store.where("production_ready")
    if only_approved:
        out = out.where("review_status = 'approved'")
    return out.orderBy(F.col("confidence_ai").desc(), "rule_id").select("rule_id", "payload")


def write_rules(store: DataFrame, path: str, only_approved: bool = True) -> None:
    """Rule payloads as JSON lines that `load_rules` reads."""
    export_rules(store, only_approved).select(F.col("payload").alias("value")).write.mode("overwrite").text(path)


# --- user predicates ----------------------------------------------------------------------

_predicates: dict[str, Callable[[], Column]] = {}


def register_predicate(name: str, make: Callable[[], Column]) -> None:
    """Name a Column test over nodes for use in `apply_predicates`."""
    _predicates[name] = make


def apply_predicates(nodes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per node and named test it meets: adds `predicate`."""
    chosen = names or sorted(_predicates)
    hits = F.array_compact(F.array(*[F.when(F.coalesce(_predicates[n](), F.lit(False)), n) for n in chosen]))
    return nodes.withColumn("predicate", F.explode(hits))
