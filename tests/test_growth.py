"""Work that grows no faster than its input: hot names, hot keys, and facts made only where they are read."""

import re

import pytest
from pyspark.sql import functions as F

from taintgrid.operators.calls import resolve_calls
from taintgrid.session import ranked_by_key


def joined_rows(df):
    """Rows that the joins of a frame's executed plan gave, the most of one join."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    most, todo = 0, [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
        todo.extend(p.children().apply(i) for i in range(p.children().size()))
    return most


def keyed(spark, df):
    return df.select(F.lit("p").alias("project_id"), F.lit("s").alias("scan_id"), "*")


def test_methods_of_one_name_meet_a_symbol_once(spark):
    """300 symbols that name 300 methods of one name: 90,000 rows before."""
    nodes = keyed(spark, spark.range(300).select(F.concat(F.lit("App.C"), "id", F.lit(".Run")).alias("resolved_symbol")))
    methods = keyed(spark, spark.range(300).select(F.concat(F.lit("m"), "id").alias("method_id"), (300 - F.col("id")).alias("ordinal"), F.lit("Run").alias("name")))
    out = resolve_calls(nodes, methods)
    assert {(r.resolved_symbol, r.callee_method_id) for r in out.collect()} == {(f"App.C{i}.Run", "m299") for i in range(300)}
    assert joined_rows(resolve_calls(nodes, methods)) <= 300


@pytest.mark.parametrize("heavy", [2, 1 << 20])
def test_numbers_of_small_and_heavy_keys(spark, heavy):
    rows = [("a", 3), ("a", 1), ("a", 2), ("b", 9), (None, 5), (None, 4), (None, 6)]
    out = ranked_by_key(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"], heavy_rows=heavy)
    assert {tuple(r) for r in out.collect()} == {("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 9, 1), (None, 4, 1), (None, 5, 2), (None, 6, 3)}


def test_facts_are_made_where_they_are_read(spark, monkeypatch):
    from taintgrid.plans import views

    made = []
    monkeypatch.setattr(views, "_memo", {})
    monkeypatch.setattr(views, "checkpoint", lambda df: made.append(1) or df)
    f = views.facts(spark, "/root/testdata/sf0.001")
    f["methods"].count()
    assert not made
    f["nodes"].count()
    assert len(made) == 1


def method_facts(spark, n):
    """n methods Run, each with one call of the symbol `App.C<i>.Run` that it returns; the first method is flagged."""
    ids = spark.range(n).select(F.col("id"), F.concat(F.lit("m"), "id").alias("method_id"), F.concat(F.lit("n"), "id").alias("node_id"))
    return {
        "nodes": keyed(spark, ids.select(
            "node_id", F.lit("InvocationExpression").alias("kind"), F.concat(F.lit("App.C"), "id", F.lit(".Run")).alias("resolved_symbol"),
            F.col("method_id").alias("containing_method_id"), F.lit(1).alias("line"), F.lit("").alias("text"), "id")),
        "methods": keyed(spark, ids.select("method_id", F.lit("Run").alias("name"), F.lit("int").alias("return_type"), F.col("id").alias("ordinal"))),
        "return_flows": keyed(spark, ids.select("method_id", F.array("node_id").alias("returned_node_ids"), (F.col("id") == 0).alias("may_return_tainted"))),
    }


def test_methods_of_one_name_and_their_callers_meet_at_the_name(spark):
    """300 methods and 300 callers: 90,000 edges before."""
    from taintgrid.operators import taint

    facts = method_facts(spark, 300)
    edges = taint.returning_edges(facts)
    assert edges.count() == 600
    assert joined_rows(taint.returning_edges(facts)) <= 600
    assert taint.tainted_returns(facts).count() == 300


def test_pairs_of_returned_nodes_and_calls_are_not_moved(spark):
    """Every pair once, also for a node returned under two names that a symbol holds; no shuffle after the join that makes them."""
    from taintgrid.operators import build

    facts = method_facts(spark, 30)
    more = keyed(spark, spark.createDataFrame([("mx", "C1", "int", 99)], "method_id string, name string, return_type string, ordinal long"))
    flow = keyed(spark, spark.createDataFrame([("mx", ["n0", "n1"], False)], "method_id string, returned_node_ids array<string>, may_return_tainted boolean"))
    facts = {**facts, "methods": facts["methods"].unionByName(more), "return_flows": facts["return_flows"].unionByName(flow)}
    out = build.edges_returned_by(facts)
    rows = [(r.src, r.dst) for r in out.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(f"n:n{i}", f"n:n{j}") for i in range(30) for j in range(30)}
    top = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top


def test_symbols_alike_in_their_first_40_characters_collide(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [(7, "Brand#11", "PROMO BURNISHED COPPER", "red one", 3), (8, "Brand#11", "PROMO BURNISHED COPPER", "blue two", 4), (9, "Brand#12", "SMALL TIN", "blue two", 4)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert [(r.new_id, r.kind) for r in queries()["rul_collisions"](spark, str(tmp_path)).collect()] == [("N7", "similar")]


def test_dominators_of_small_graphs_take_no_rounds(spark, monkeypatch):
    """Against the rounds, on graphs with loops, parts out of reach, an entry without edges and two entries."""
    from taintgrid.operators import graph

    edges = spark.createDataFrame(
        [(g, a, b) for g in range(4) for a, b in [(1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 2), (5, 6), (7, 6), (6, 6), (3, 1)][g:]], "g int, src int, dst int")
    entries = spark.createDataFrame([(g, n, n) for g in range(4) for n in (1, 2)] + [(1, 9, 9), (8, 1, 1)], "g int, source int, node int")
    want = {(r.g, r.source, r.node, tuple(r.doms)) for r in graph._spread_dominators(edges, entries, ["g"]).collect()}

    def refuse(*_):
        raise AssertionError("rounds")

    monkeypatch.setattr(graph, "_first_paths", refuse)
    assert {(r.g, r.source, r.node, tuple(r.doms)) for r in graph.dominators(edges, entries, ["g"]).collect()} == want


def test_exports_are_written_compressed(spark, tmp_path):
    """Every export is smaller than a quarter of its text."""
    from taintgrid.plans import exports, views

    exports.write_exports(views.facts(spark, "/root/testdata/sf0.001", roles=False), f"{tmp_path}/e")
    on_disk = sum(p.stat().st_size for p in (tmp_path / "e").rglob("part-*"))
    text = spark.read.text(f"{tmp_path}/e").agg(F.sum(F.length("value"))).first()[0]
    assert 0 < on_disk < text / 4


def made_rows(df, kind):
    """The most rows that one step of a kind gave in a frame's executed plan."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    most, todo = 0, [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while todo:
        p = todo.pop()
        if kind in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
        if "QueryStage" in p.nodeName():
            todo.append(p.plan())
        todo.extend(p.children().apply(i) for i in range(p.children().size()))
    return most


def test_points_are_copied_to_levels_that_intervals_have(spark):
    """1,000 points and intervals of four lines: 32,000 copies before."""
    from taintgrid.operators.lines import between_lines

    points = spark.range(1000).select(F.lit("m").alias("method"), (F.col("id") * 7).cast("int").alias("line"))
    pairs = spark.range(7000).select(F.lit("m").alias("method"), "id", F.col("id").cast("int").alias("lo"), (F.col("id") + 3).cast("int").alias("hi"))
    hit = between_lines(pairs, points, ["method"], ["id"], "lo", "hi")
    assert {r.id for r in hit.collect()} == {i for i in range(7000) if (i + 3) // 7 * 7 >= i and (i + 3) // 7 < 1000}
    assert made_rows(between_lines(pairs, points, ["method"], ["id"], "lo", "hi"), "Generate") <= 20000
    none = between_lines(pairs.where("id < 0"), points, ["method"], ["id"], "lo", "hi")
    assert none.count() == 0 and between_lines(pairs.withColumn("hi", F.col("lo") - 1), points, ["method"], ["id"], "lo", "hi", anti=True).count() == 7000


def source_facts(spark, per):
    """Methods m<i> of per[i] sources `call<k>()` on line k, and assignments on line 1000 + k that hold the first ones; an empty text, too."""
    rows = [(f"m{i}", k) for i, n in enumerate(per) for k in range(n)]
    at = keyed(spark, spark.createDataFrame(rows, "m string, k int"))
    text = F.when(F.col("k") == 3, F.lit("")).otherwise(F.concat(F.lit("call"), "k", F.lit("()")))
    nodes = at.select("project_id", "scan_id", F.col("m").alias("containing_method_id"), F.concat_ws("_", F.lit("n"), "m", "k").alias("node_id"),
                      F.col("k").alias("line"), text.alias("text"), F.lit(True).alias("is_known_source"))
    asg = at.where("k < 5").select("project_id", "scan_id", F.col("m").alias("containing_method_id"), F.concat_ws("_", F.lit("a"), "m", "k").alias("assignment_id"),
                                   F.when(F.col("k") == 4, 7).otherwise(F.col("k") + 1000).alias("line"), F.concat(F.lit("x + call"), "k", F.lit("()")).alias("source_text"), F.lit(False).alias("is_literal"))
    return {"nodes": nodes, "assignments": asg}


def test_texts_of_methods_with_few_sources_are_not_cut(spark):
    """Every text was cut into grams, a row each, however few sources its method had."""
    from taintgrid.operators.build import FEW_SOURCES, edges_source_text

    def want(per):
        held = {(f"n:n_m{i}_{k}", f"a:a_m{i}_{k}") for i, n in enumerate(per) for k in range(min(n, 5)) if k != 3}
        return held | {(f"n:n_m{i}_7", f"a:a_m{i}_4") for i, n in enumerate(per) if n > 7}

    few = edges_source_text(source_facts(spark, [1, 5, 9]))
    assert {(r.src, r.dst) for r in few.collect()} == want([1, 5, 9])
    assert "Generate" not in few._jdf.queryExecution().executedPlan().toString()
    both = [2, 9, FEW_SOURCES + 8]
    got = edges_source_text(source_facts(spark, both)).select("src", "dst").collect()
    assert {tuple(r) for r in got} == want(both) and len(got) == len(want(both))


def test_flows_of_small_methods_take_no_rounds(spark, monkeypatch):
    """Spread and nearest origin of each method went through rounds of joins; both ways give the same paths."""
    import random

    from taintgrid.operators import graph as G

    rnd = random.Random(3)
    edges = spark.createDataFrame([(g, rnd.randrange(9), rnd.randrange(9)) for g in range(40) for _ in range(rnd.randrange(1, 20))], "g int, src int, dst int")
    marks = lambda n: spark.createDataFrame([(g, rnd.randrange(10)) for g in range(42) for _ in range(n)], "g int, node int")
    seeds, wanted, blocked = marks(2), marks(5), marks(1)

    def rows():
        return sorted((r.g, r.node, list(r.path)) for r in G.nearest_paths(edges, seeds, wanted, blocked, ["g"]).collect())

    def fail(*_, **__):
        raise AssertionError("a round was made")

    with monkeypatch.context() as m:
        m.setattr(G, "closure", fail)
        m.setattr(G, "_first_paths", fail)
        few = rows()
    with monkeypatch.context() as m:
        m.setattr(G, "ROW_MARKS", 18)  # about half of the graphs go through rounds
        mixed = rows()
    assert few == mixed and {len(p) for _, _, p in few} >= {1, 2, 3, 4}


def test_levels_of_small_graphs_take_no_rounds(spark, monkeypatch):
    """A round of the peeling wrote all nodes of all graphs again; both ways give the same levels."""
    import random

    from taintgrid.operators import graph as G

    rnd = random.Random(5)
    ends = [(g, *sorted(rnd.sample(range(12), 2))) for g in range(40) for _ in range(rnd.randrange(1, 14))]
    edges = spark.createDataFrame([(g, b, a) if g % 2 and rnd.random() < 0.2 else (g, a, b) for g, a, b in ends] + [(3, 5, 5)], "g int, src int, dst int")
    nodes = spark.createDataFrame([(g, n) for g in range(42) for n in range(12) if n or g != 4], "g int, node int")
    entries = spark.createDataFrame([(g, rnd.randrange(3)) for g in range(42)], "g int, node int")

    def rows():
        return [sorted(map(tuple, G.topo_levels(nodes, edges, ["g"], e).select("g", "node", "level", "is_cyclic").collect())) for e in (entries, None)]

    def fail(*_, **__):
        raise AssertionError("a round was made")

    with monkeypatch.context() as m:
        m.setattr(G, "_spread_levels", fail)
        few = rows()
    with monkeypatch.context() as m:
        m.setattr(G, "ROW_MARKS", 19)  # about half of the graphs go through rounds
        mixed = rows()
    assert few == mixed and {r[3] for r in few[0]} == {True, False} and {r[3] for r in few[1]} == {False}


def test_checks_of_edge_rules_are_one_join_each(spark):
    """Seven rules asked for the parameters or nodes of their methods, each by a join of its own."""
    from taintgrid.operators import build as B
    from taintgrid.plans.views import facts

    f = dict(facts(spark, "/root/testdata/sf0.001"))
    dfg = B.build_dfg(f)
    plan = dfg._jdf.queryExecution().optimizedPlan().toString()
    checks = [line for line in plan.splitlines() if re.search(r"Join .*[( ]_(name|node)#", line)]
    assert len(checks) == 3, checks
    one_by_one = [{tuple(r) for r in B.RULES[name](f).select("src", "dst").collect()} for name in B.RULES]
    assert {tuple(r) for r in dfg.select("src", "dst").collect()} == set().union(*one_by_one)


def test_few_points_of_a_key_are_looked_through(spark, monkeypatch):
    """Points were copied to levels and intervals cut into ranges, however few points a key had; both ways give the same rows."""
    import random

    from taintgrid.operators import lines

    rnd = random.Random(2)
    points = spark.createDataFrame([(rnd.randrange(30), rnd.choice([None, *range(60)])) for _ in range(200)], "m int, line int")
    pairs = spark.createDataFrame(
        [(rnd.randrange(33), rnd.randrange(40), rnd.choice([None, *range(60)]), rnd.randrange(60)) for _ in range(300)], "m int, id int, lo int, hi int")

    def rows(anti):
        return lines.between_lines(pairs, points, ["m"], ["m", "id"], "lo", "hi", anti=anti)

    few = [rows(anti) for anti in (False, True)]
    assert not any("Generate" in df._jdf.queryExecution().executedPlan().toString() for df in few)
    with monkeypatch.context() as m:
        m.setattr(lines, "FEW_POINTS", 0)
        cut = [rows(anti) for anti in (False, True)]
        assert all("Generate" in df._jdf.queryExecution().executedPlan().toString() for df in cut)
    key = lambda df: sorted(map(repr, df.select("m", "id", "lo", "hi").collect()))
    assert [key(df) for df in few] == [key(df) for df in cut] and sum(df.count() for df in few) == 300
