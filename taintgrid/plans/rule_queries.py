"""Queries over rules: the catalogue applied to derived calls, and parts read as rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from taintgrid.operators import rules as R
from taintgrid.plans import views as V
from taintgrid.plans.cases import case
from taintgrid.plans.fact_queries import _CAT, _SYMS
from taintgrid.plans.views import _values, fact_ctes, facts
from taintgrid.sources.catalog import load_rules

# parts as rules, in SQL that both sides read
PART_RULES = """
SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'GEN-SQL-' || lpad(CAST(p_partkey % 50 AS STRING), 3, '0') ELSE 'R-' || CAST(p_partkey AS STRING) END AS id,
  CASE WHEN p_partkey % 41 = 0 THEN 'odd' WHEN p_partkey % 3 = 0 THEN 'sink' WHEN p_partkey % 3 = 1 THEN 'source' ELSE 'sanitizer' END AS rule_type,
  CASE WHEN p_partkey % 10 = 0 THEN p_brand ELSE p_brand || '.' || p_type || '.Operator.Module.Member.' || replace(p_name, ' ', '') END AS symbol,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || ' of ' || p_brand || ' in ' || p_type END AS description,
  CASE p_size % 4 WHEN 0 THEN 'SQL_INJECTION' WHEN 1 THEN 'XSS' WHEN 2 THEN 'BOGUS' END AS vulnerability,
  CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'WILD' ELSE '' END AS severity, CASE WHEN p_size % 5 = 0 THEN '89' ELSE 'CWE-89' END AS cwe,
  CASE WHEN p_size > 45 THEN 11.0 WHEN p_size > 5 THEN 7.5 END AS cvss_base, CASE WHEN p_size % 2 = 0 THEN 'high' WHEN p_size % 7 = 0 THEN 'weird' END AS confidence_level,
  CASE WHEN p_size % 6 = 0 THEN 'USER_INPUT' WHEN p_size % 6 = 1 THEN 'ODD_INPUT' END AS taint_label, CASE WHEN p_size % 2 = 0 THEN 1.0 WHEN p_size % 3 = 0 THEN 2.5 END AS severity_multiplier,
  CASE WHEN p_size % 3 = 0 THEN CAST(p_size / 40.0 AS DOUBLE) END AS confidence_score, CASE WHEN p_size % 4 = 1 THEN 'XSS' WHEN p_size % 4 = 2 THEN 'XSS,NOPE' ELSE '' END AS sanitizes_text,
  CASE p_size % 3 WHEN 0 THEN 'ENCODING' WHEN 1 THEN 'MAGIC' ELSE '' END AS sanitizer_type, CASE WHEN p_size % 2 = 0 THEN 'generic' WHEN p_size % 3 = 0 THEN 'generic,cobol' ELSE '' END AS frameworks_text,
  CASE WHEN p_size % 5 > 1 THEN 'fix it' ELSE '' END AS remediation, p_size
FROM part"""
_PR = f"pr AS ({PART_RULES})"


def part_rules(spark, d):
    items = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    base = V.run_sql(spark, d, V._braced(PART_RULES, V.TABLES))
    none = lambda t: F.lit(None).cast(t)
    return base.withColumns({
        "sanitizes": items("sanitizes_text"), "frameworks": items("frameworks_text"), "tags": F.when(F.col("p_size") % 2 == 0, F.array(F.lit("t"))),
        "tainted_args": F.when(F.col("p_size") % 2 == 0, F.array(F.lit(0))), "always_vulnerable": F.when(F.col("p_size") % 3 == 0, F.lit(False)), "implicit": none("boolean"),
        "data_format": F.when(F.col("p_size") % 2 == 0, "string").otherwise("xml"), "authentication_context": F.when(F.col("p_size") % 3 == 0, "any"),
        "encoding_context": F.when(F.col("p_size") % 2 == 0, F.array(F.lit("c"))), "limitations": none("string")})


_E = """(id IS NULL)::INT + (ordinal % 41 = 0)::INT
  + CASE WHEN rule_type = 'sink' THEN (vulnerability IS NULL)::INT + coalesce(vulnerability = 'BOGUS', false)::INT + (severity = 'WILD')::INT + coalesce(cvss_base > 10, false)::INT
    WHEN rule_type = 'source' THEN (taint_label IS NULL)::INT + coalesce(taint_label = 'ODD_INPUT', false)::INT
    WHEN rule_type = 'sanitizer' THEN (sanitizes_text = '')::INT + contains(sanitizes_text, 'NOPE')::INT + (sanitizer_type = 'MAGIC')::INT + (confidence_score IS NULL AND confidence_level IS NULL)::INT
      + coalesce(confidence_score > 1, false)::INT ELSE 0 END"""
_W = """(name = '')::INT + (description = '')::INT
  + CASE WHEN rule_type = 'sink' THEN (p_size % 2 <> 0)::INT + (p_size % 3 <> 0)::INT + (confidence_level IS NULL)::INT + coalesce(confidence_level = 'weird', false)::INT + (severity = '')::INT
      + (cwe = '89')::INT + (cvss_base IS NULL)::INT + (remediation = '')::INT
    WHEN rule_type = 'source' THEN (severity_multiplier IS NULL)::INT + coalesce(severity_multiplier > 2, false)::INT + (p_size % 2 <> 0)::INT
    WHEN rule_type = 'sanitizer' THEN (sanitizer_type = '')::INT + (confidence_score IS NULL AND confidence_level IS NOT NULL)::INT + (p_size % 2 <> 0)::INT + 1 ELSE 0 END
  + CASE WHEN rule_type <> 'odd' THEN (frameworks_text = '')::INT + contains(frameworks_text, 'cobol')::INT + (p_size % 2 <> 0)::INT + (ordinal % 10 = 0)::INT ELSE 0 END"""
_VAL = f"vr AS (SELECT *, {_E} AS ne, {_W} AS nw FROM pr)"


@case("rul_validate", f"WITH {_PR}, {_VAL} SELECT ordinal, ne AS n_errors, nw AS n_warnings, ne = 0 AS is_valid FROM vr")
def rul_validate(spark, d):
    v = R.validate_rules(part_rules(spark, d))
    return v.select("ordinal", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "is_valid")


@case("rul_validate_catalog", f"""WITH {_PR} SELECT ordinal, CASE WHEN ordinal % 41 = 0 THEN 'unknown rule_type' ELSE '' END || CASE WHEN id IS NULL THEN '|missing id' ELSE '' END ||
  CASE WHEN rule_type = 'sink' AND vulnerability IS NULL THEN '|missing vulnerability' ELSE '' END || CASE WHEN rule_type = 'source' AND taint_label IS NULL THEN '|missing taint_label' ELSE '' END ||
  CASE WHEN rule_type = 'sanitizer' AND confidence_score IS NULL THEN '|missing confidence' WHEN rule_type = 'sanitizer' AND confidence_score > 1 THEN '|confidence out of range' ELSE '' END AS faults FROM pr""")
def rul_validate_catalog(spark, d):
    v = R.validate_catalog(part_rules(spark, d))
    first = F.when(F.array_contains("errors", "unknown rule_type"), "unknown rule_type").otherwise("")
    rest = F.array_join(F.transform(F.filter("errors", lambda e: e != "unknown rule_type"), lambda e: F.concat(F.lit("|"), e)), "")
    return v.select("ordinal", F.concat(first, rest).alias("faults"))


_IDS = f"""ex AS (SELECT DISTINCT 'GEN-SQL-' || lpad(CAST(s_suppkey % 20 AS STRING), 3, '0') AS id FROM supplier),
ok AS (SELECT pr.*, id IS NOT NULL AND id NOT IN (SELECT id FROM ex) AND (starts_with(id, 'GEN-') OR contains(id, '-')) AS good FROM pr),
fi AS (SELECT *, good AND ordinal = min(CASE WHEN good THEN ordinal END) OVER (PARTITION BY id) AS keep FROM ok),
tk AS (SELECT id FROM ex UNION SELECT id FROM fi WHERE keep),
tp AS (SELECT regexp_extract(id, '^(.+-.+)-(\\d+)$', 1) AS prefix, max(CAST(regexp_extract(id, '-(\\d+)$', 1) AS INT)) AS top FROM tk WHERE regexp_matches(id, '^.+-.+-\\d+$') GROUP BY 1),
nw AS (SELECT ordinal, CASE WHEN rule_type = 'sink' THEN CASE vulnerability WHEN 'SQL_INJECTION' THEN 'GEN-SQL' WHEN 'XSS' THEN 'GEN-XSS' ELSE 'GEN-SINK' END WHEN rule_type = 'source' THEN 'GEN-SRC' ELSE 'GEN-SAN' END AS prefix FROM fi WHERE NOT keep),
nn AS (SELECT nw.*, coalesce(tp.top, 0) + row_number() OVER (PARTITION BY nw.prefix ORDER BY ordinal) AS n FROM nw LEFT JOIN tp ON tp.prefix = nw.prefix)"""


@case("rul_assign_ids", f"""WITH {_PR}, {_IDS} SELECT ordinal, id AS assigned_id FROM fi WHERE keep
UNION ALL SELECT ordinal, prefix || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS STRING), 3, '0') ELSE CAST(n AS STRING) END FROM nn""")
def rul_assign_ids(spark, d):
    ex = V.table(spark, d, "supplier").select(F.concat(F.lit("GEN-SQL-"), F.lpad((F.col("s_suppkey") % 20).cast("string"), 3, "0")).alias("id")).distinct()
    return R.assign_ids(part_rules(spark, d), ex).select("ordinal", "assigned_id")


_COLL = """nw AS (SELECT 'N' || CAST(ordinal AS STRING) AS new_id, symbol FROM pr WHERE ordinal % 7 = 0), ex AS (SELECT DISTINCT symbol AS existing_symbol FROM pr WHERE ordinal % 7 <> 0)"""


@case("rul_collisions", f"""WITH {_PR}, {_COLL} SELECT new_id, existing_symbol, CASE WHEN symbol = existing_symbol THEN 'exact' ELSE 'similar' END AS kind
FROM nw JOIN ex ON symbol = existing_symbol OR (length(symbol) > 20 AND starts_with(existing_symbol, substr(symbol, 1, 40)))""")
def rul_collisions(spark, d):
    r = part_rules(spark, d)
    new = r.where("ordinal % 7 = 0").withColumn("id", F.concat(F.lit("N"), F.col("ordinal").cast("string")))
    # symbols that agree in as many characters as this are similar, whatever follows
    return R.collisions(new, r.where("ordinal % 7 <> 0"), head=40)


@case("rul_ai_confidence", f"""WITH {_PR}, {_VAL} SELECT ordinal, CAST(round(100 * greatest(0, 1 - 0.15 * ne - 0.05 * nw - CASE WHEN ordinal % 10 = 0 THEN 0.2 ELSE 0 END
  - CASE WHEN length(description) < 30 THEN 0.1 ELSE 0 END - CASE WHEN rule_type = 'sink' AND remediation = '' THEN 0.1 ELSE 0 END)) AS BIGINT) AS score FROM vr""")
def rul_ai_confidence(spark, d):
    v = R.validate_rules(part_rules(spark, d))
    return v.select("ordinal", F.round(R.ai_confidence() * 100).cast("long").alias("score"))


@case("rul_readiness", f"""WITH {_PR}, {_VAL}, cl AS (SELECT ordinal, EXISTS (SELECT 1 FROM pr b WHERE b.ordinal <> a.ordinal AND b.symbol = a.symbol) AS hit FROM pr a)
SELECT count(*) AS total, count(*) FILTER (ne = 0) AS valid, count(*) FILTER (hit) AS colliding, count(*) FILTER (ne = 0 AND NOT hit) AS ready FROM vr JOIN cl USING (ordinal)""")
def rul_readiness(spark, d):
    raw = part_rules(spark, d).withColumn("_blank", F.col("id").isNull())
    key = F.concat(F.lit("K"), F.col("ordinal").cast("string"))
    v = R.validate_rules(raw).withColumn("id", key).drop("_blank")
    n = v.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = v.join(n, "symbol", "left_semi").select(F.col("id").alias("new_id"))
    return R.generation_summary(R.readiness(v, found)).select("total", "valid", "colliding", "ready")


@case("rul_custom_merge", f"""WITH {_PR}, both_ AS (SELECT ordinal, id, symbol, false AS c FROM pr WHERE id IS NOT NULL AND ordinal % 2 = 0 UNION ALL SELECT ordinal, id, symbol, true FROM pr WHERE id IS NOT NULL AND ordinal % 2 = 1)
SELECT id, c AS is_custom, symbol FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, CASE WHEN c THEN ordinal ELSE -ordinal END) AS rn FROM both_) WHERE rn = 1""")
def rul_custom_merge(spark, d):
    r = part_rules(spark, d).where("id is not null")
    return R.with_custom_rules(r.where("ordinal % 2 = 0"), r.where("ordinal % 2 = 1")).select("id", "is_custom", "symbol")


@case("rul_filter_framework", f"WITH {_PR} SELECT ordinal FROM pr WHERE contains(frameworks_text, 'generic') OR contains(frameworks_text, 'cobol')")
def rul_filter_framework(spark, d):
    return R.filter_framework(part_rules(spark, d), ["cobol"]).select("ordinal")


@case("rul_query", f"WITH {_PR} SELECT ordinal FROM pr WHERE rule_type = 'sink' AND vulnerability = 'XSS' AND severity = 'HIGH'")
def rul_query(spark, d):
    return R.query_rules(part_rules(spark, d), "sink", "XSS", severity="high").select("ordinal")


@case("rul_maps", f"""WITH {_PR} SELECT rule_type, symbol, min(ordinal) AS ordinal, CASE WHEN rule_type = 'source' THEN coalesce(arg_max(coalesce(taint_label, 'USER_INPUT'), ordinal), 'USER_INPUT') END AS taint_label
FROM pr WHERE rule_type IN ('source', 'sanitizer') GROUP BY 1, 2""")
def rul_maps(spark, d):
    return R.rule_maps(part_rules(spark, d)).select("rule_type", "symbol", "ordinal", "taint_label")


@case("rul_load_stats", f"""WITH {_PR} SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM pr UNION ALL SELECT 'rule_type', rule_type, count(*) FROM pr GROUP BY rule_type
UNION ALL SELECT 'vulnerability', vulnerability, count(*) FROM pr WHERE vulnerability IS NOT NULL GROUP BY vulnerability UNION ALL SELECT 'taint_label', taint_label, count(*) FROM pr WHERE taint_label IS NOT NULL GROUP BY taint_label
UNION ALL SELECT 'sanitizer_type', sanitizer_type, count(*) FROM pr GROUP BY sanitizer_type""")
def rul_load_stats(spark, d):
    return R.load_stats(part_rules(spark, d))


_SETS = """SELECT 'write_sinks' AS set_name, symbol FROM cat WHERE rule_type = 'sink' AND vk = 'PATH_TRAVERSAL' AND regexp_matches(lower(symbol), 'write|append|create|copytoasync')
UNION ALL SELECT 'environment_sources', symbol FROM cat WHERE label = 'ENVIRONMENT_INPUT'
UNION ALL SELECT 'high_confidence_sanitizers', symbol FROM cat WHERE rule_type = 'sanitizer' AND conf >= 0.9
UNION ALL SELECT 'linq_sanitizers', symbol FROM cat WHERE rule_type = 'sanitizer' AND contains(symbol, '.Linq.')
UNION ALL SELECT 'always_vulnerable_sinks', symbol FROM cat WHERE alw = 'true'
UNION ALL SELECT 'second_order_sources', symbol FROM cat WHERE label = 'STORED_INPUT'"""
_CATSQL = "cat AS (SELECT * FROM " + _values([(r["rule_type"], r["symbol"], r["vulnerability"], r["taint_label"], r["confidence_score"], str(bool(r["always_vulnerable"])).lower()) for r in _CAT], "rule_type, symbol, vk, label, conf, alw") + " q)"


@case("rul_named_sets_use", fact_ctes(_SYMS, _CATSQL, f"sets AS ({_SETS})") + """
SELECT set_name, count(DISTINCT s.symbol) AS n_symbols, CAST(sum(s.n) AS BIGINT) AS n_calls FROM (SELECT DISTINCT set_name, y.symbol, y.n FROM sets t JOIN syms y ON starts_with(y.symbol, t.symbol)) s GROUP BY 1""")
def rul_named_sets_use(spark, d):
    from taintgrid.operators.prefix import prefix_matches

    rules = load_rules(spark)
    names = ["write_sinks", "environment_sources", "high_confidence_sanitizers", "linq_sanitizers", "always_vulnerable_sinks", "second_order_sources"]
    table = None
    for n in names:
        part = R.named_rule_sets()[n](rules).select("symbol", F.lit(n).alias("set_name"))
        table = part if table is None else table.union(part)
    syms = facts(spark, d)["nodes"].groupBy("resolved_symbol").agg(F.count(F.lit(1)).alias("n"))
    hits = prefix_matches(syms, table).select(F.col("_symbol").alias("resolved_symbol"), "set_name").distinct()
    return hits.join(syms, "resolved_symbol").groupBy("set_name").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum("n").alias("n_calls"))


@case("rul_predicates", fact_ctes() + "SELECT node_id, unnest(list_filter([CASE WHEN is_async_call THEN 'async' END, CASE WHEN contains(text, '+') THEN 'concat' END], lambda x: x IS NOT NULL)) AS predicate FROM f_nodes")
def rul_predicates(spark, d):
    R.register_predicate("async", lambda: F.col("is_async_call"))
    R.register_predicate("concat", lambda: F.col("text").contains("+"))
    return R.apply_predicates(facts(spark, d)["nodes"], ["async", "concat"]).select("node_id", "predicate")


# --- store ------------------------------------------------------------------------------

_ST = """st AS (SELECT 'R' || CAST(ordinal AS STRING) AS rule_id, *, CAST((p_size % 10) / 10.0 AS DOUBLE) AS confidence_ai, p_size % 2 = 0 AS production_ready,
  CASE p_size % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' ELSE 'rejected' END AS review_status, 'c' || lpad(CAST(ordinal AS STRING), 9, '0') AS created_at FROM pr)"""


def rule_store(spark, d):
    none = F.lit(None).cast("string")
    r = part_rules(spark, d)
    return r.select(
        F.concat(F.lit("R"), F.col("ordinal").cast("string")).alias("rule_id"), "rule_type", "vulnerability", "symbol", "name", "description", "frameworks",
        F.to_json(F.struct("id", "symbol", "rule_type")).alias("payload"), ((F.col("p_size") % 10) / 10.0).alias("confidence_ai"), (F.col("p_size") % 2 == 0).alias("production_ready"),
        F.when(F.col("p_size") % 3 == 0, "approved").when(F.col("p_size") % 3 == 1, "pending").otherwise("rejected").alias("review_status"), none.alias("reviewed_by"),
        none.alias("reviewed_at"), none.alias("review_notes"), F.lit(1).alias("version"), F.concat(F.lit("c"), F.lpad(F.col("ordinal").cast("string"), 9, "0")).alias("created_at"),
        F.lit("u").alias("updated_at"))


@case("rul_upsert", f"WITH {_PR}, {_ST} SELECT rule_id, CASE WHEN ordinal % 4 = 0 THEN 'changed' ELSE name END AS name, CASE WHEN ordinal % 4 = 0 THEN 2 ELSE 1 END AS version, review_status FROM st UNION ALL SELECT 'X' || CAST(n_nationkey AS STRING), n_name, 1, 'pending' FROM nation")
def rul_upsert(spark, d):
    s = rule_store(spark, d)
    again = s.where("cast(substring(rule_id, 2, 20) as bigint) % 4 = 0").select("rule_id", F.lit("changed").alias("name"))
    new = V.table(spark, d, "nation").select(F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("rule_id"), F.col("n_name").alias("name"))
    return R.upsert_rules(s, again.unionByName(new), "now").select("rule_id", "name", "version", "review_status")


@case("rul_review", f"""WITH {_PR}, {_ST} SELECT rule_id, CASE WHEN ordinal % 6 = 0 THEN 'pending' WHEN ordinal % 6 = 3 THEN 'approved' ELSE review_status END AS review_status, CASE WHEN ordinal % 6 = 3 THEN 'kim' END AS reviewed_by FROM st""")
def rul_review(spark, d):
    s = rule_store(spark, d)
    n = F.substring("rule_id", 2, 20).cast("long")
    dec = s.where(n % 3 == 0).select("rule_id", F.when(n % 6 == 0, "pending").otherwise("approved").alias("decision"), F.lit("kim").alias("reviewer"), F.lit("ok").alias("notes"))
    return R.review_rules(s, dec, "now").select("rule_id", "review_status", "reviewed_by")


@case("rul_query_store", f"WITH {_PR}, {_ST} SELECT rule_id FROM st WHERE rule_type = 'sink' AND production_ready AND review_status = 'pending'")
def rul_query_store(spark, d):
    return R.query_store(rule_store(spark, d), rule_type="sink", ready=True, status="pending").select("rule_id")


@case("rul_recent", f"WITH {_PR}, {_ST} SELECT rule_id FROM st ORDER BY created_at DESC, rule_id LIMIT 20")
def rul_recent(spark, d):
    return R.query_store(rule_store(spark, d), recent=20).select("rule_id")


@case("rul_store_symbols", f"WITH {_PR} SELECT DISTINCT symbol FROM pr")
def rul_store_symbols(spark, d):
    return R.store_values(rule_store(spark, d), "symbol")


@case("rul_search", f"""WITH {_PR}, {_ST}, sc AS (SELECT rule_id, len(list_intersect(list_distinct(regexp_split_to_array(lower(concat_ws(' ', name, description)), '\\W+')), ['red', 'ring'])) AS score,
  contains(lower(name || chr(10) || description || chr(10) || symbol), 'red ring') AS whole FROM st) SELECT rule_id, score FROM sc WHERE score > 0 OR whole ORDER BY score DESC, rule_id LIMIT 25""")
def rul_search(spark, d):
    return R.search_rules(rule_store(spark, d), "red ring", 25).select("rule_id", "score")


@case("rul_delete", f"WITH {_PR}, {_ST} SELECT rule_id FROM st WHERE review_status <> 'rejected' AND ordinal % 9 <> 0")
def rul_delete(spark, d):
    s = rule_store(spark, d)
    return R.delete_rules(s, s.where("cast(substring(rule_id, 2, 20) as bigint) % 9 = 0"), rejected=True).select("rule_id")


@case("rul_store_stats", f"""WITH {_PR}, {_ST}, fw AS (SELECT unnest(list_filter(string_split(frameworks_text, ','), lambda x: x <> '')) AS v FROM st)
SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM st UNION ALL SELECT 'rule_type', rule_type, count(*) FROM st GROUP BY rule_type
UNION ALL SELECT 'sink_kind', vulnerability, count(*) FROM st WHERE rule_type = 'sink' GROUP BY vulnerability UNION ALL SELECT 'framework', v, count(*) FROM fw GROUP BY v
UNION ALL SELECT 'avg_confidence', '', CAST(round(avg(confidence_ai) * 1000) AS BIGINT) FROM st""")
def rul_store_stats(spark, d):
    return R.rule_stats(rule_store(spark, d))


@case("src_export_rules", f"WITH {_PR}, {_ST} SELECT rule_id FROM st WHERE production_ready AND review_status = 'approved'")
def src_export_rules(spark, d):
    return R.export_rules(rule_store(spark, d)).select("rule_id")


@case("rul_extract", """
SELECT event_id, CAST(n AS INT) AS rule_no, CAST(CASE WHEN event_id % 4 = 3 THEN event_id ELSE event_id + n END AS STRING) AS symbol FROM events, (SELECT unnest([0, 1]) AS n)
WHERE event_id % 5 <> 4 AND (event_id % 4 <> 3 OR n = 0)""")
def rul_extract(spark, d):
    ev = V.table(spark, d, "events").select("event_id")
    one = lambda k: F.concat(F.lit('{"rule_type": "sink", "symbol": "'), (F.col("event_id") + k).cast("string"), F.lit('"}'))
    two = F.concat(F.lit("["), one(0), F.lit(", "), one(1), F.lit("]"))
    m = F.col("event_id") % 4
    text = F.when(m == 0, two).when(m == 1, F.concat(F.lit('{"rules": '), two, F.lit("}"))).when(m == 2, F.concat(F.lit('{"x": 1, "items": '), two, F.lit("}"))).otherwise(one(0))
    rows = ev.withColumn("reply", F.when(F.col("event_id") % 5 == 4, '{"note": "none"}').otherwise(text))
    return R.extract_rules(rows).select("event_id", "rule_no", F.get_json_object("rule_json", "$.symbol").alias("symbol"))
