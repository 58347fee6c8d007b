"""Whole texts are stored and matched, and no task order decides between conflicting rows."""

import random

from pyspark.sql import functions as F

from taintgrid.operators import history, rules
from taintgrid.operators.grams import contains_pairs
from taintgrid.session import one_per


def test_pieces_of_any_length_are_found_in_whole_texts(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé𝄞 ") for _ in range(n))
    texts = [(k, word(n)) for k in "xy" for n in (1, 5, 7, 8, 9, 40, 1023, 1024, 1032, 5000)] + [("x", ""), ("x", None), ("y", "same head, then A"), ("y", "same head, then B")]
    held = [(k, t[i : i + n]) for k, t in texts if t for n in (1, 3, 7, 8, 9, 30, 1030) for i in (0, len(t) // 2, max(len(t) - n, 0))]
    pieces = [*held, ("x", "zz"), ("y", "same head, then A"), ("x", "absent from all of them"), ("x", ""), ("y", None), ("z", "ab")]
    want = {(k, t, p) for k, t in texts for j, p in pieces if k == j and t and p and p in t}
    got = contains_pairs(
        spark.createDataFrame(texts, "k string, text string"), spark.createDataFrame(pieces, "k string, piece string"), ["k"]).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_symbols_alike_at_the_beginning_only_do_not_collide(spark):
    head = "Company.Product.Data.Access.Layer.Commands."  # more than 40 characters
    new = spark.createDataFrame([("N1", head + "Read"), ("N2", head + "Write")], "id string, symbol string")
    old = spark.createDataFrame([(head + "ReadAll",), (head + "Write",)], "symbol string")
    got = {tuple(r) for r in rules.collisions(new, old).collect()}
    assert got == {("N1", head + "ReadAll", "similar"), ("N2", head + "Write", "exact")}
    assert rules.collisions(new, old, head=40).count() == 4


def test_stored_texts_are_whole_unless_a_length_is_given(spark):
    long = "x" * 900
    row = spark.range(1).select(
        F.lit("p").alias("project_id"), F.lit("s").alias("scan_id"), F.lit("v").alias("vuln_id"), *[F.lit(long).alias(c) for c in ("code_snippet", "description", "remediation")],
        *[F.lit("t").alias(c) for c in ("vulnerability_kind", "severity", "confidence", "finding_source", "cwe", "vector", "file", "method_name", "class_name", "title", "source_label", "sink_label")],
        F.lit(1.0).alias("cvss_score"), F.lit(1).alias("line"), F.lit(2).alias("sink_line"), *[F.lit(False).alias(c) for c in ("is_in_loop", "has_partial_sanitizer", "is_entry_point")])
    whole = history.to_stored(row).first()
    assert (whole.code_snippet, whole.description, whole.remediation) == (long, long, long)
    cut = history.to_stored(row, 200, 500).first()
    assert (len(cut.code_snippet), len(cut.description), len(cut.remediation)) == (200, 500, 500)
    said = spark.createDataFrame([("s", "1", "run", "a"), ("s", "2", "run", long), ("s", "2", "run", "b")], "scan_id string, updated_at string, status string, message string")
    assert [tuple(r) for r in history.progress(said).collect()] == [("s", "run", long, "2")]
    assert len(history.progress(said, 500).first().message) == 500


def test_scans_of_other_projects_keep_theirs(spark):
    scans = spark.createDataFrame([("p", "1", ["a"]), ("q", "1", ["a"])], "project_name string, scan_id string, tags array<string>")
    one = spark.createDataFrame([("p", "1", ["b"])], "project_name string, scan_id string, tags array<string>")
    assert {(r.project_name, *r.tags) for r in history.add_tags(scans, one).collect()} == {("p", "a", "b"), ("q", "a")}
    assert [r.project_name for r in history.delete_scans(scans, one).collect()] == ["q"]
    assert history.delete_scans(scans, one.select("scan_id")).count() == 0


def test_of_conflicting_rows_the_smallest_wins(spark):
    rows = spark.createDataFrame([(1, "b", None), (1, "a", "z"), (2, "c", "c")], "id int, x string, y string")
    for part in (1, 3):
        got = one_per(rows.repartition(part), ["id"]).orderBy("id").collect()
        assert [tuple(r) for r in got] == [(1, "a", "z"), (2, "c", "c")]
