"""Queries of the corpus operators over the given tables, and their SQL checks."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgrid.llm import bpe, itq, jaccard, licenses, lm, merkle, mixing, multiset, nearest, packing, pii, quality, trie
from taintgrid.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


BATCH_BYTES = str(8 << 20)


def prepare(spark: SparkSession) -> None:
    """Bound the batches of rows that Python workers get, and let new workers import this package from where the
    driver has it, as in local runs (on a cluster it is shipped with the application, --py-files)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


JACCARD_SQL = """
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents),
places AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM words),
runs AS (
  SELECT doc_id, i, n, w || ' ' || lead(w, 1) OVER z || ' ' || lead(w, 2) OVER z || ' ' || lead(w, 3) OVER z || ' ' || lead(w, 4) OVER z AS g
  FROM places WINDOW z AS (PARTITION BY doc_id ORDER BY i)),
different AS (
  SELECT DISTINCT doc_id, g FROM runs WHERE i <= n - 4
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
one AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS n, g FROM different),
shared AS (SELECT g FROM one GROUP BY g HAVING count(*) > 1),
few AS MATERIALIZED (SELECT one.* FROM one JOIN shared USING (g)),
meets AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM few a JOIN few b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM meets WHERE k / (na + nb - k) >= 0.8
  UNION SELECT x.doc_id, y.doc_id FROM words x JOIN words y ON x.text = y.text AND x.doc_id <> y.doc_id),
reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
counts AS (
  SELECT l.a, count(*) AS n_links, count(DISTINCT CASE WHEN x.text <> y.text THEN y.text END) AS n_texts
  FROM links l JOIN words x ON x.doc_id = l.a JOIN words y ON y.doc_id = l.b GROUP BY l.a)
SELECT d.doc_id, coalesce(z.class_id, d.doc_id) AS class_id, coalesce(c.n_links, 0) AS n_links, coalesce(c.n_texts, 0) AS n_texts
FROM documents d LEFT JOIN least z ON z.a = d.doc_id LEFT JOIN counts c ON c.a = d.doc_id
"""


@query("op5_jaccard_join", JACCARD_SQL)
def op5(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op1_pii")
def op1(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents")).withColumn("base_sha256", F.sha2("base", 256)).drop("base")


def token_digests(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "doc_id", *more, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_bpe")
def op6(spark, sf_dir):
    return token_digests(bpe.round_trip(table(spark, sf_dir, "documents")))


def licences_sql() -> str:
    values = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    norm = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    t = licenses.THRESHOLD
    return f"""
WITH template(t, licence, text) AS (VALUES {values}),
lines AS (SELECT doc_id, trim(unnest(string_split({norm.format("coalesce(text, '')")}, chr(10)))) AS unit, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
units AS (
  SELECT DISTINCT doc_id, unit FROM lines WHERE unit <> ''
  UNION SELECT doc_id, string_agg(unit, ' ' ORDER BY pos) FROM lines WHERE unit <> '' GROUP BY doc_id),
cut AS (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM units),
sized AS (SELECT *, len(w) - 1 AS n FROM cut WHERE len(w) > 1),
tcut AS (SELECT t, licence, string_split(trim({norm.format("text")}), ' ') AS w FROM template),
tsized AS (SELECT *, len(w) - 1 AS n FROM tcut WHERE len(w) > 1),
near AS (SELECT s.doc_id, s.unit, s.w, s.n, t.t FROM sized s JOIN tsized t ON s.n BETWEEN t.n * {t} / (2 - {t}) AND t.n * (2 - {t}) / {t}),
own AS (SELECT doc_id, unit, pair, count(*) AS k FROM (SELECT doc_id, unit, unnest(list_transform(range(1, n + 1), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM (SELECT DISTINCT doc_id, unit, w, n FROM near)) GROUP BY ALL),
theirs AS (SELECT t, pair, count(*) AS k FROM (SELECT t, unnest(list_transform(range(1, n + 1), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM tsized) GROUP BY ALL),
dices AS (
  SELECT near.doc_id, near.unit, near.t, 2.0::DOUBLE * sum(least(own.k, theirs.k)) / (any_value(near.n) + any_value(z.n)) AS dice
  FROM near JOIN own ON own.doc_id = near.doc_id AND own.unit = near.unit JOIN theirs ON theirs.t = near.t AND theirs.pair = own.pair JOIN tsized z ON z.t = near.t
  GROUP BY ALL)
SELECT d.doc_id, z.licence, max(d.dice) AS dice, count(*) AS hits FROM dices d JOIN tsized z ON z.t = d.t WHERE d.dice >= {t} GROUP BY ALL
"""


@query("op3_license_scan", licences_sql())
def op3(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


MIXING_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {mixing.POWER}) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, weight / (SELECT sum(weight) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
drawn AS (SELECT *, (('0x' || md5('{mixing.SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0 AS u FROM documents),
counted AS (SELECT d.doc_id, count(s.k) AS n FROM drawn d JOIN steps s ON s.source IS NOT DISTINCT FROM d.source AND s.c <= d.u GROUP BY d.doc_id),
copies AS (SELECT doc_id, unnest(range(n))::INT AS copy FROM counted)
SELECT d.*, c.copy, md5('{mixing.SEED}:' || d.doc_id || ':' || c.copy) AS shuffle_key FROM documents d JOIN copies c ON c.doc_id = d.doc_id
"""


@query("op4_source_mixing", MIXING_SQL)
def op4(spark, sf_dir):
    return mixing.replicate(table(spark, sf_dir, "documents"))


@query("op2_nearest")
def op2(spark, sf_dir):
    return nearest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_lm_score")
def op7(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


@query("op8_embedding_copies")
def op8(spark, sf_dir):
    return itq.near_copies(table(spark, sf_dir, "embeddings"))


@query("op9_sharding")
def op9(spark, sf_dir):
    out = packing.assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_multiset_hash")
def op11(spark, sf_dir):
    return multiset.compared(table(spark, sf_dir, "documents"))


def crc_ctes(name: str, ids: str, from_: str) -> str:
    """CTEs of a recursive SQL query: name(id, crc) with the CRC-32 of the decimal text of each id, a byte at a time."""
    bits = "list_reduce(list_prepend(xor(c & 255, ascii(s[i + 1])::BIGINT), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"""{name}_steps AS (
  SELECT DISTINCT {ids} AS id, CAST({ids} AS VARCHAR) AS s, 0 AS i, 4294967295::BIGINT AS c FROM {from_} WHERE {ids} IS NOT NULL
  UNION ALL SELECT id, s, i + 1, xor(c >> 8, {bits}) FROM {name}_steps WHERE i < strlen(s)),
{name} AS (SELECT id, xor(c, 4294967295) AS crc FROM {name}_steps WHERE i = strlen(s))"""


def merkle_sql() -> str:
    def leaf(n_chars: str) -> str:
        parts = [f"coalesce(strlen(({v})::VARCHAR) || ':' || ({v})::VARCHAR, '-')" for v in ("doc_id", "source", "lang", n_chars, "text")]
        return f"sha256({' || '.join(parts)})"

    def above(name: str, key: str) -> str:
        return f"SELECT {key}lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY {key}lvl, pos // 2, n"

    return f"""
WITH RECURSIVE {crc_ctes("crcs", "doc_id", "documents")},
rows AS (SELECT d.doc_id, lang, {leaf("n_chars")} AS leaf, CASE WHEN coalesce(crc % 7 = 0, false) THEN {leaf("n_chars::HUGEINT + 1")} END AS shown FROM documents d LEFT JOIN crcs ON crcs.id = d.doc_id),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rows),
lv AS (SELECT lang, 0 AS lvl, pos, leaf AS h, n FROM leaves UNION ALL {above("lv", "lang, ")}),
tops AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
tl AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM tops UNION ALL {above("tl", "")}),
steps AS MATERIALIZED (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY part, lvl) AS i, sib, on_left FROM (
  SELECT l.rid, 0 AS part, v.lvl, s.h AS sib, (l.pos >> v.lvl) % 2 = 1 AS on_left FROM leaves l JOIN (SELECT DISTINCT lang, lvl FROM lv WHERE n > 1) v ON v.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN lv s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = v.lvl AND s.pos = xor(l.pos >> v.lvl, 1)
  UNION ALL
  SELECT l.rid, 1, v.lvl, s.h, (t.pos >> v.lvl) % 2 = 1 FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT DISTINCT lvl FROM tl WHERE n > 1) v
    LEFT JOIN tl s ON s.lvl = v.lvl AND s.pos = xor(t.pos >> v.lvl, 1))),
proofs AS (SELECT rid, sha256(string_agg(coalesce(sib, ''), '' ORDER BY i)) AS proof, count(*) AS n FROM steps GROUP BY rid),
fold AS (
  SELECT rid, 0 AS i, coalesce(shown, leaf) AS cur FROM leaves
  UNION ALL SELECT f.rid, f.i + 1, sha256(CASE WHEN s.on_left THEN s.sib || cur ELSE cur || coalesce(s.sib, '') END) FROM fold f JOIN steps s ON s.rid = f.rid AND s.i = f.i + 1)
SELECT l.doc_id, l.leaf, t.subroot, r.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.cur AS folded_root, f.cur = r.h AS verified
FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT h FROM tl WHERE n = 1) r ON true LEFT JOIN proofs p ON p.rid = l.rid JOIN fold f ON f.rid = l.rid AND f.i = coalesce(p.n, 0)
"""


@query("op12_merkle_manifest", merkle_sql())
def op12(spark, sf_dir):
    return merkle.check_rows(table(spark, sf_dir, "documents"))


TRIE_SQL = f"""
WITH RECURSIVE {crc_ctes("crcs", "conv_id", "conversations")},
filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS i,
    md5(strlen(role) || ':' || role || text) AS h, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM filled),
sizes AS (SELECT conv_id, count(*) AS m FROM turns GROUP BY 1),
convs AS MATERIALIZED (
  SELECT s.conv_id, s.conv_id - s.conv_id % 20 AS base, crc % 4 AS lent, least(crc % 4, coalesce(b.m, 0)) AS k, least(crc % 4, coalesce(b.m, 0)) + greatest(s.m - crc % 4, 0) AS n
  FROM sizes s JOIN crcs ON crcs.id = s.conv_id LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % 20),
rebuilt AS (
  SELECT c.conv_id, c.n, t.i AS p, h, words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.k
  UNION ALL SELECT c.conv_id, c.n, t.i - c.lent + c.k, h, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.lent),
prefixes AS MATERIALIZED (
  SELECT conv_id, n, p AS depth, words, md5(string_agg(h, '' ORDER BY p) OVER (PARTITION BY conv_id ORDER BY p)) AS node FROM rebuilt
  UNION ALL SELECT conv_id, n, 0, 0, '' FROM convs),
nodes AS MATERIALIZED (
  SELECT node, depth, words, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '') AS ends FROM prefixes GROUP BY 1, 2, 3),
linked AS MATERIALIZED (SELECT x.*, u.node AS parent, u.conv_id AS parent_conv_id FROM nodes x LEFT JOIN (SELECT p.conv_id AS by_conv, p.depth, z.node, z.conv_id FROM prefixes p JOIN nodes z ON z.node = p.node AND z.depth = p.depth) u ON u.by_conv = x.conv_id AND u.depth = x.depth - 1),
kids AS (SELECT parent, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY 1),
full_nodes AS (SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.parent = l.node),
sums AS (
  SELECT a.node, a.depth, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.words)::BIGINT AS saved_tokens
  FROM full_nodes x JOIN prefixes a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY 1, 2)
SELECT conv_id, x.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM full_nodes x JOIN sums s ON s.node = x.node AND s.depth = x.depth
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark, sf_dir):
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
