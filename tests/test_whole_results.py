"""No silent ends, no dropped or doubled rows."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from taintgrid import session
from taintgrid.operators import classify, graph, history, verdicts
from taintgrid.sources.facts import _place, merge_exports


def test_loops_end_on_an_empty_frontier_only(spark):
    chain = spark.createDataFrame([("m", i, i + 1) for i in range(30)], "g string, src int, dst int")
    seeds = spark.createDataFrame([("m", 0)], "g string, node int")
    assert graph.closure(chain, seeds, ["g"]).agg(F.max("depth")).first()[0] == 30
    assert graph.closure(chain, seeds, ["g"], max_depth=4).count() == 5
    pairs = spark.createDataFrame([("m", 0, 30)], "g string, source int, target int")
    assert [r.hops for r in graph.simple_paths(chain, pairs, ["g"]).collect()] == [30]
    assert graph.simple_paths(chain, pairs, ["g"], cutoff=20).count() == 0


def test_findings_of_unlisted_kinds_stay(spark):
    rows = spark.createDataFrame([(1, "LDAP_INJECTION"), (2, "XXE"), (3, None)], "id int, vulnerability_kind string")
    got = {r.id: (r.vulnerability_kind, r.kind_cwe) for r in classify._with_kind(rows, classify.load_kinds(spark)).collect()}
    assert got == {1: ("LDAP_INJECTION", "CWE-693"), 2: ("XXE", "CWE-611"), 3: (None, "CWE-693")}


def test_repeated_tags_and_errors_do_not_double_scans(spark):
    scans = spark.createDataFrame([("s1", ["a"]), ("s2", None)], "scan_id string, tags array<string>")
    tags = spark.createDataFrame([("s1", ["b"]), ("s1", ["b", "c"])], "scan_id string, tags array<string>")
    assert {r.scan_id: r.tags for r in history.add_tags(scans, tags).collect()} == {"s1": ["a", "b", "c"], "s2": []}


def test_order_of_updates_with_equal_times_is_fixed(spark):
    rows = spark.createDataFrame([("s", "1", "x"), ("s", "1", "y")], "scan_id string, updated_at string, note string")
    first = history.upsert_scans(rows.limit(0), rows).collect()
    assert history.upsert_scans(rows.limit(0), rows.orderBy(F.desc("note")).repartition(3)).collect() == first


def test_all_findings_are_reviewed_unless_a_number_is_given(spark):
    rows = spark.range(120).select(
        F.lit("p").alias("project_id"), F.lit("s").alias("scan_id"), F.lit("high").alias("confidence"), F.lit("HIGH").alias("severity"),
        F.col("id").cast("int").alias("line"), F.col("id").cast("string").alias("vuln_id"), F.lit("").alias("source_label"), F.lit("").alias("sink_label"),
        F.lit("").alias("code_snippet"), F.lit("XXE").alias("vulnerability_kind"), F.lit(False).alias("has_partial_sanitizer"), F.lit("").alias("file"),
        F.lit("").alias("title"), F.lit("").alias("description"))
    every = verdicts.select_for_review(rows)
    assert sorted(r.review_no for r in every.collect()) == list(range(1, 121))
    assert verdicts.select_for_review(rows, 50).count() == 50


def test_methods_of_large_classes_keep_their_order(spark):
    rows = spark.createDataFrame([(0, 0, 4999), (0, 1, 0), (1, 0, 0)], "b int, c int, m int")
    got = [r[0] for r in rows.select(_place(F.col("b"), F.col("c"), F.col("m"))).collect()]
    assert got == sorted(set(got))
    with pytest.raises(Exception, match="too large"):
        rows.select(_place(F.col("b"), F.col("c"), F.col("m") + (1 << 18))).collect()


def test_later_exports_come_later(spark):
    one = spark.createDataFrame([("a", 5, 1)], "name string, ordinal bigint, batch_no bigint")
    merged = merge_exports({"methods": one, "nodes": one}, {"methods": one, "nodes": one})
    for t in merged.values():
        assert t.select("ordinal").distinct().count() == 2 and t.select("batch_no").distinct().count() == 2


def test_a_cluster_needs_a_shared_folder():
    def fake(master):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None),
            sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, applicationId="x"))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session._stage_folder(fake(master))
    for master in ("local", "local[*]", "local[8]"):
        assert session._stage_folder(fake(master))


def test_user_rules_reach_roles_and_sink_kinds(spark):
    from taintgrid.operators.prefix import with_roles
    from taintgrid.plans.scan import with_user_rules
    from taintgrid.sources.catalog import load_roles, load_rules, load_sink_kinds

    own = load_rules(spark).limit(1).select(
        *[F.lit({"symbol": "My.Directory.Search", "rule_type": "sink", "vulnerability": "LDAP_INJECTION"}[c]).alias(c)
          if c in ("symbol", "rule_type", "vulnerability") else F.col(c) for c in load_rules(spark).columns])
    roles, kinds = with_user_rules(load_roles(spark), load_sink_kinds(spark), own)
    node = spark.createDataFrame([("My.Directory.Search.Find",), ("Other.Call",)], "resolved_symbol string")
    assert {r.resolved_symbol: r.is_known_sink for r in with_roles(node, roles).collect()} == {"My.Directory.Search.Find": True, "Other.Call": False}
    assert kinds.where("symbol = 'My.Directory.Search'").first().vulnerability_kind == "LDAP_INJECTION"
    assert kinds.groupBy("ordinal").count().where("count > 1").count() == 0
