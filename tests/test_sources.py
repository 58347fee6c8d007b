"""Files: discovery, SARIF and graph round trips."""

import json

from pyspark.sql import functions as F

from taintgrid.operators import weighted as W
from taintgrid.sources.facts import discover_files
from taintgrid.sources.sinks import read_graph, write_graph, write_sarif


def test_discovery_skips_build_folders(spark, tmp_path):
    for name in ("a/X.cs", "a/bin/Y.cs", "TestResults/Z.cs", "b/W.txt", "b/V.cs"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("class C {}")
    names = [r.path.rsplit("/", 1)[-1] for r in discover_files(spark, str(tmp_path)).collect()]
    assert names == ["X.cs", "V.cs"]


def test_graph_round_trip_drops_unknown_rows(spark, tmp_path):
    n = spark.createDataFrame([("p", "s", "a", "METHOD_CALL"), ("p", "s", "b", "METHOD_CALL"), ("p", "s", "c", "ODD")], "project_id string, scan_id string, node string, kind string")
    e = spark.createDataFrame(
        [("p", "s", "a", "b", "flows_to"), ("p", "s", "a", "c", "flows_to"), ("p", "s", "b", "a", "odd")], "project_id string, scan_id string, src string, dst string, edge_kind string")
    write_graph(n, e, str(tmp_path / "g"))
    nodes, edges = read_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 2 and [(r.src, r.dst) for r in edges.collect()] == [("a", "b")]


def test_sarif_log_has_one_run_with_all_results(spark, tmp_path):
    from tests.test_fixtures import VULN, keyed, vuln

    v = keyed(spark.createDataFrame([vuln("a", "XSS", "LOW"), vuln("b", "XSS", "CRITICAL", line=2)], VULN))
    write_sarif(v, str(tmp_path / "s"))
    text = spark.read.text(str(tmp_path / "s")).select("value").collect()[0].value
    log = json.loads(text)
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and [r["level"] for r in run["results"]] == ["error", "note"]
    assert run["tool"]["driver"]["rules"][0]["defaultConfiguration"]["level"] == "error"


def test_best_walk_has_the_confidence_of_the_best_path(spark):
    n = spark.createDataFrame(
        [(i, "METHOD_CALL", i == 0, i == 4, False, False, i == 2) for i in range(5)],
        "node int, kind string, is_source boolean, is_sink boolean, is_sanitizer boolean, is_async boolean, is_in_loop boolean").withColumn("g", F.lit(1))
    e = spark.createDataFrame(
        [(0, 1, "aliases", False), (1, 4, "flows_to", True), (0, 2, "flows_to", False), (2, 3, "flows_to", False), (3, 0, "flows_to", False), (3, 4, "aliases", False), (2, 1, "flows_to", False)],
        "src int, dst int, edge_kind string, is_conditional boolean").withColumn("g", F.lit(1))
    src = n.where("is_source").select("g", "node", F.lit("USER_INPUT").alias("taint_label"))
    best = W.propagate_weighted(n, e, src, ["g"]).agg(F.max("confidence")).first()[0]
    every = W.propagate_weighted(n, e, src, ["g"], mode="all").agg(F.max("confidence")).first()[0]
    assert best == every == 0.828


def test_counters_of_walks_by_fate(spark):
    n = spark.createDataFrame(
        [(i, "METHOD_CALL", i == 0, i == 3, i == 4, False, False) for i in range(7)],
        "node int, kind string, is_source boolean, is_sink boolean, is_sanitizer boolean, is_async boolean, is_in_loop boolean").withColumn("g", F.lit(1))
    e = spark.createDataFrame(
        [(0, 1), (1, 2), (2, 0), (2, 1), (2, 3), (1, 4), (4, 5), (3, 6)], "src int, dst int").selectExpr("src", "dst", "'flows_to' as edge_kind", "src = 1 and dst = 2 as is_conditional", "1 as g")
    src = n.where("is_source").select("g", "node", F.lit("USER_INPUT").alias("taint_label"))
    effect = n.where("is_sanitizer").select("g", "node", F.lit(0.95).alias("san_confidence"), F.expr("cast(null as array<string>)").alias("san_kinds"))
    for mode in ("all", "best"):
        out, levels = W.propagate_counted(n, e, src, ["g"], effect, mode=mode)
        stats = W.propagation_stats(W.weighted_results(out, n, ["g"]), src, n, ["g"], levels).first()
        assert (stats.sources, stats.results, stats.visited, stats.blocked, stats.cycles, stats.weak, stats.depth_hits, stats.deepest) == (1, 1, 3, 1, 2, 0, 0, 3)
    out, levels = W.propagate_counted(n, e, src, ["g"], effect, max_depth=1)
    assert out.count() == 0 and {(r.depth, r.fate): r.n for r in levels.collect()} == {(0, "go"): 1, (1, "deep"): 2}
    weak = W.propagate_counted(n, e, src, ["g"], effect, min_confidence=0.9)[1]
    assert {r.fate for r in weak.collect()} == {"go", "weak", "blocked"}
    edges = W.taint_edges(W.dedupe_weighted(W.propagate_weighted(n, e, src, ["g"], effect), ["g"]), ["g"]).collect()
    assert [(r.src, r.dst, r.edge_kind, r.confidence) for r in edges] == [(0, 3, "taints", 0.8)]
