"""Small typed facts with known answers."""

import json

from pyspark.sql import functions as F

from taintgrid.functions.symbols import normalize_symbol
from taintgrid.operators import classify as K
from taintgrid.operators import taint as T
from taintgrid.operators import verdicts as D
from taintgrid.operators.report import report_documents
from taintgrid.sources.catalog import catalog_rows
from taintgrid.sources.facts import read_facts
from taintgrid.sources.sinks import load_report, write_json_report

ARG = "array<struct<position:int,text:string,resolved_type:string,is_literal:boolean,data_flow_origin:string,origin_parameter_name:string,origin_node_id:string,named_parameter:string>>"
NODE = (
    f"node_id string, kind string, text string, file string, line int, resolved_symbol string, resolved_type string, containing_method_id string, arguments {ARG}, "
    "is_known_sink boolean, is_known_source boolean, is_known_sanitizer boolean, ordinal long")


def keyed(df):
    return df.select(F.lit("p").alias("project_id"), F.lit("s").alias("scan_id"), "*")


def call(node, method, symbol, line, args=(), ordinal=0):
    return (node, "InvocationExpression", symbol + "()", "f.cs", line, symbol, None, method, list(args), False, False, False, ordinal)


def method_facts(spark, names, nodes, returns, params=(), text_type="string"):
    methods = [(m, n, text_type, "c1", i, False) for i, (m, n) in enumerate(names)]
    return {
        "methods": keyed(spark.createDataFrame(methods, "method_id string, name string, return_type string, containing_class_id string, ordinal int, is_entry_point boolean")),
        "nodes": keyed(spark.createDataFrame(nodes, NODE)),
        "return_flows": keyed(spark.createDataFrame(returns, "method_id string, returned_node_ids array<string>, may_return_tainted boolean")),
        "parameters": keyed(spark.createDataFrame(list(params), "method_id string, name string, position int")),
    }


def test_tainted_returns_reach_callers_and_callee_parameters(spark):
    origin = (0, "x", None, False, "local_variable", None, "nb", None)
    nodes = [call("nb", "A", "App.B", 10), call("nc", "B", "App.C", 20), call("ra", "A", "App.Out", 11), call("rb", "B", "App.Out", 21), call("nd", "A", "App.D", 12, [origin])]
    f = method_facts(
        spark, [("A", "A"), ("B", "B"), ("C", "C"), ("D", "D")], nodes, [("A", ["ra"], False), ("B", ["rb"], False), ("C", [], True)], [("D", "query", 0)])
    returns = T.tainted_returns(f)
    assert {r.method_id for r in returns.collect()} == {"A", "B", "C"}
    assert {(r.method_id, r.parameter_name) for r in T.tainted_callee_params(f, returns).collect()} == {("D", "query")}


def test_body_reader_is_tainted_when_asked_directly(spark):
    f = method_facts(spark, [("R", "ReadRequestBody"), ("O", "Other")], [call("n", "O", "App.Out", 1)], [("R", [], False), ("O", [], False)])
    assert [r.method_id for r in T.body_readers(f).collect()] == ["R"]
    assert T.tainted_returns(f).count() == 0  # no flagged method in the scan, so nothing is added


def test_symbol_normalisation(spark):
    rows = [
        ("SqlCommand", "new SqlCommand(q)", None, "System.Data.SqlClient.SqlCommand..ctor"),
        ("Create", "XmlReader.Create(x)", None, "System.Xml.XmlReader.Create"),
        ("Load", "doc.Load(x)", "System.Xml.XmlDocument", "System.Xml.XmlDocument.Load"),
        ("FromSqlRaw", "x.FromSqlRaw(q)", None, "Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.FromSqlRaw"),
        ("HtmlString", "new HtmlString(x)", None, "Microsoft.AspNetCore.Html.HtmlString..ctor"),
        ("global::A.B", "", None, "A.B"),
        ("ToString", "x.ToString()", None, None),
    ]
    df = spark.createDataFrame(rows, "s string, t string, r string, want string")
    got = df.select("want", normalize_symbol(F.col("s"), F.col("t"), F.col("r")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


VULN = (
    "vuln_id string, finding_source string, vulnerability_kind string, severity string, confidence string, cwe string, vector string, cvss_score double, file string, line int, "
    "sink_line int, code_snippet string, method_id string, method_name string, class_name string, title string, description string, remediation string, source_label string, "
    "sink_label string, taint_label string, source_file string, is_in_loop boolean, has_partial_sanitizer boolean, is_entry_point boolean, n_originals long")


def vuln(vid, kind, sev="HIGH", conf="high", score=7.5, snippet="", line=1, entry=False):
    return (vid, "taint", kind, sev, conf, "CWE-1", "v", score, "a.cs", line, line, snippet, "m", "M", "C", "t", "d", "r", None, snippet, "USER_INPUT", "a.cs", False, False, entry, 1)


def test_path_flow_keeps_the_read_sink(spark):
    rows = [vuln("a", "PATH_TRAVERSAL", snippet="File.ReadAllText(p)"), vuln("b", "PATH_TRAVERSAL", "MEDIUM", snippet="Path.Combine(p)", line=2), vuln("c", "SSRF", line=3)]
    out = {r.vuln_id: r.n_originals for r in K.consolidate_flows(keyed(spark.createDataFrame(rows, VULN))).collect()}
    assert out == {"a": 2, "c": 1}


def test_single_path_finding_is_left_alone(spark):
    rows = [vuln("b", "PATH_TRAVERSAL", snippet="Path.Combine(p)")]
    assert K.consolidate_flows(keyed(spark.createDataFrame(rows, VULN))).count() == 1


def test_score_is_kept_unless_the_band_changes(spark):
    rows = [vuln("a", "CSRF", "MEDIUM", "high", 6.5, entry=True), vuln("b", "CSRF", "MEDIUM", "high", 5.0, entry=True)]
    v = keyed(spark.createDataFrame(rows, VULN)).withColumn("has_auth", F.lit(False))
    out = {r.vuln_id: (r.severity, r.cvss_score) for r in K.adjust_severity(v, {}).collect()}
    assert out == {"a": ("HIGH", 7.0), "b": ("MEDIUM", 5.0)}


def test_false_positive_suggestion_only_annotates(spark):
    v = keyed(spark.createDataFrame([vuln("a", "SSRF", "CRITICAL")], VULN))
    verdict = keyed(spark.createDataFrame([("a", True, "low", "no")], "vuln_id string, is_false_positive boolean, confidence_adjusted string, reasoning string"))
    r = D.apply_verdicts(v, verdict).collect()
    assert len(r) == 1 and r[0].fp_suggested and r[0].confidence == "high" and r[0].severity == "CRITICAL"


def test_failed_scorer_keeps_findings(spark):
    def broken(_):
        raise RuntimeError("down")

    out = D.score(spark.createDataFrame([(1, "x")], "id int, prompt string"), broken).collect()
    assert out[0].reply is None and "down" in out[0].score_error


def test_catalogue_counts():
    rows = catalog_rows()
    by = lambda t: sum(r["rule_type"] == t for r in rows)
    assert (len(rows), by("sink"), by("source"), by("sanitizer")) == (317, 127, 95, 95)
    assert len({r["id"] for r in rows}) == 317


def test_report_pages_hold_every_finding(spark, tmp_path):
    rows = [vuln(f"v{i}", "XSS", line=i) for i in range(7)]
    v = keyed(spark.createDataFrame(rows, VULN))
    pages = report_documents(v, "now", page_rows=3).select("page", F.size("document.vulnerabilities").alias("n")).orderBy("page").collect()
    assert [r.n for r in pages] == [3, 3, 1]
    write_json_report(v, str(tmp_path / "r"), "now")
    doc = json.loads(load_report(spark, str(tmp_path / "r"), "s").collect()[0].document)
    assert doc["summary"]["total_vulnerabilities"] == 7 and len(doc["vulnerabilities"]) == 7


def test_read_facts_applies_defaults_and_drops(spark, tmp_path):
    doc = {
        "metadata": {"files": ["a.cs"], "nuget_references": ["Dapper/2.0"]},
        "compilation_unit": {"classes": [{"class_id": "c", "name": "C", "full_name": "N.C", "methods": [
            {"method_id": "m", "name": "M", "signature": "M()", "return_type": "string", "containing_class_id": "c",
             "parameters": [{"name": "p", "resolved_type": "System.String", "position": 0}]}]}]},
        "semantic_nodes": [{"node_id": "n", "kind": "InvocationExpression", "resolved_symbol": "ReadLine", "arguments": [{"text": "x"}]}],
        "data_flow": {"assignments": [{"assignment_id": "a1", "containing_method_id": "m"}, {"assignment_id": "a2"}]},
    }
    folder = tmp_path / "e" / "project_id=p" / "scan_id=1"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text(json.dumps(doc, indent=1))
    (folder / "y.json").write_text("{ broken")
    f = read_facts(spark, str(tmp_path / "e"))
    assert f["corrupt"].count() == 1
    assert [r.assignment_id for r in f["assignments"].collect()] == ["a1"]
    node = f["nodes"].collect()[0]
    assert (node.resolved_symbol, node.text, node.line, node.scan_id) == ("System.Console.ReadLine", "", 0, "1")
    assert node.arguments[0].data_flow_origin == "unknown"
    meth = f["methods"].collect()[0]
    assert (meth.accessibility, meth.attributes, meth.is_entry_point) == ("private", [], False)
    assert f["parameters"].collect()[0].binding_attributes == []
