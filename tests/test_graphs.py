"""Graph and line operators against brute force on small random data."""

import random

import pytest
from pyspark.sql import functions as F

from taintgrid.operators import cycles
from taintgrid.operators import graph as G
from taintgrid.operators.lines import between_lines, near_lines
from taintgrid.operators.state import Levels, bucketed, stored
from taintgrid.session import ranked

K = ["g"]


def random_edges(seed, n=7, m=11):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)})


def reach(edges, start, without=None):
    seen, todo = set(), [start] if start != without else []
    while todo:
        x = todo.pop()
        if x in seen:
            continue
        seen.add(x)
        todo += [b for a, b in edges if a == x and b != without]
    return seen


def frames(spark, graphs):
    return spark.createDataFrame([(g, a, b) for g, es in graphs.items() for a, b in es], "g int, src int, dst int")


def test_components_and_dominators_match_brute_force(spark):
    graphs = {s: random_edges(s) for s in range(12)}
    df = frames(spark, graphs)
    got = {(r.g, r.node) for r in G.cycle_nodes(df, K).collect()}
    want = {(g, v) for g, es in graphs.items() for v in range(7) if any(v in reach(es, b) for a, b in es if a == v)}
    assert got == want
    entries = spark.createDataFrame([(g, 0) for g in graphs], "g int, node int")
    doms = {(r.g, r.node): set(r.doms) for r in G.dominators(df, entries, K).collect()}
    for g, es in graphs.items():
        for v in reach(es, 0):
            assert doms[(g, v)] == {u for u in reach(es, 0) if u == v or v not in reach(es, 0, without=u)}


def largest_in_component(edges):
    out = set()
    for v in {x for e in edges for x in e}:
        ahead = {y for a, b in edges if a == v for y in reach(edges, b)}
        if v in ahead:
            out.add((v, max(y for y in ahead if any(v in reach(edges, b) for a, b in edges if a == y))))
    return out


@pytest.mark.parametrize("small", [62, 3])
def test_components_of_small_large_and_dense_graphs(spark, small, monkeypatch):
    monkeypatch.setattr(cycles, "SMALL", small)
    rnd = random.Random(8)
    graphs = {}
    for g in range(10):
        n = rnd.choice([3, 6, 20, 40])
        graphs[g] = sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(int(n * rnd.choice([0.8, 1.2, 2.5])))})
    graphs[50] = [(i, (i + 1) % 70) for i in range(70)]  # one ring
    got = {(r.g, r.node, r.component) for r in G.components(frames(spark, graphs), K).collect()}
    assert got == {(g, *x) for g, es in graphs.items() for x in largest_in_component(es)}
    # one graph without keys, with names as nodes
    names = [(f"n{a:02}", f"n{b:02}") for a, b in graphs[50] + [(70, 71)]]
    one = spark.createDataFrame(names, "src string, dst string")
    assert {(r.node, r.component) for r in G.components(one, []).collect()} == {(f"n{i:02}", "n69") for i in range(70)}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(cycles, "checkpoint", lambda df, real=cycles.checkpoint: rounds.append(1) or real(df))
    writes = []
    monkeypatch.setattr(cycles, "counted", lambda df, by=None, real=cycles.counted: writes.append(1) or real(df, by))
    chain = spark.range(1000).selectExpr("1 as g", "id as src", "id + 1 as dst")
    assert G.components(chain, K).count() == 0
    assert len(writes) <= 5 * 11 and len(rounds) <= 11  # five tables a round, one on the way back


def test_closure_moves_the_frontier_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = bucketed(spark.range(50).selectExpr("1 as g", "id as src", "id + 1 as dst"), ["g", "src"])
        seen = Levels(["g", "node"])
        first = stored(spark.range(1).selectExpr("1 as g", "id as node"), ["g", "node"])
        seen.add(first)
        step = first.frame.selectExpr("g", "node as src").join(edges, ["g", "src"]).selectExpr("g", "dst as node").distinct()
        plan = seen.without(step)._jdf.queryExecution().executedPlan().toString()
        assert first.rows == 1 and plan.count("Exchange") == 1  # that of distinct: neither edges nor what was seen moves
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_levels_are_merged_and_nothing_is_lost(spark):
    seen = Levels(["node"])
    for i in range(20):
        seen.add(stored(spark.range(i * 10, i * 10 + 10).withColumnRenamed("id", "node"), ["node"]))
    assert len(seen.parts) <= Levels.MOST + 1 and sorted(r.node for r in seen.all().collect()) == list(range(200))
    assert seen.without(spark.range(190, 210).withColumnRenamed("id", "node")).count() == 10


def test_folded_levels_have_each_key_once(spark):
    seen = Levels(["node"], lambda df: df.groupBy("node").agg(F.bit_or("mask").alias("mask")))
    for i in range(9):
        seen.add(stored(spark.range(40).selectExpr("id as node", f"1L << {i} as mask"), ["node"]))
    assert [(r.node, r.mask) for r in seen.fold(seen.all()).orderBy("node").collect()] == [(i, 511) for i in range(40)]


def test_masks_of_many_seeds_match_brute_force(spark):
    rnd = random.Random(2)
    graphs = {0: sorted({(i, min(90, i + rnd.choice([17, 23, 31]))) for i in range(90) for _ in range(2)} | {(89, 3), (70, 1)}), 1: random_edges(4)}
    pairs = [(g, rnd.randrange(n), rnd.randrange(n)) for g, n in ((0, 90), (1, 7)) for _ in range(220)]  # more than 64 seeds a graph
    marked = [(0, v) for v in range(0, 90, 7)] + [(1, 2), (1, 4)]
    p, m = spark.createDataFrame(pairs, "g int, source int, target int"), spark.createDataFrame(marked, "g int, node int")
    df = frames(spark, graphs)
    ahead = {(g, v): reach(es, v) for g, es in graphs.items() for v in range(91)}
    want = {(g, s, t, v) for g, s, t in pairs for h, v in marked if g == h and v in ahead[g, s] and t in ahead[g, v] and v not in (s, t)}
    assert {(r.g, r.source, r.target, r.node) for r in G.on_any_path(df, p, m, K).collect()} == want
    nodes = {(g, v) for g, s, t in pairs for v in range(91) if v in ahead[g, s] and t in ahead[g, v]}
    assert {(r.g, r.node) for r in G.on_pair_walks(df, p, K).collect()} == nodes
    clean = {g: [(a, b) for a, b in es if (g, b) not in marked] for g, es in graphs.items()}
    got = {(r.g, r.source, r.target): r.is_hit for r in G.all_paths_hit(df, p, m, K).collect()}
    for g, s, t in pairs:
        free = (g, s) not in marked and t in reach(clean[g], s)
        assert got[g, s, t] == (t in ahead[g, s] and not free)


def test_all_paths_hit_matches_deletion(spark):
    graphs = {s: random_edges(s + 50) for s in range(12)}
    pairs = spark.createDataFrame([(g, 0, 6) for g in graphs], "g int, source int, target int")
    marked = {g: {1, 2, (g % 3) + 3} for g in graphs}
    marks = spark.createDataFrame([(g, v) for g, vs in marked.items() for v in vs], "g int, node int")
    got = {r.g: r.is_hit for r in G.all_paths_hit(frames(spark, graphs), pairs, marks, K).collect()}
    for g, es in graphs.items():
        free = [(a, b) for a, b in es if a not in marked[g] and b not in marked[g]]
        assert got[g] == (6 in reach(es, 0) and 6 not in reach(free, 0))


def test_marking_more_never_unhits_and_edges_never_unreach(spark):
    graphs = {s: random_edges(s + 90) for s in range(6)}
    seeds = spark.createDataFrame([(g, 0) for g in graphs], "g int, node int")
    small = {(r.g, r.node) for r in G.reachable(frames(spark, graphs), seeds, K).collect()}
    more = {g: es + [(0, 5)] for g, es in graphs.items()}
    assert small <= {(r.g, r.node) for r in G.reachable(frames(spark, more), seeds, K).collect()}


def test_lines_match_brute_force(spark):
    rnd = random.Random(3)
    pairs = [(i, rnd.randrange(400), rnd.randrange(400)) for i in range(200)]
    points = [rnd.randrange(400) for _ in range(12)]
    p = spark.createDataFrame([(i, "m", a, b) for i, a, b in pairs], "i int, method string, lo int, hi int")
    q = spark.createDataFrame([("m", x) for x in points], "method string, line int")
    hit = {r.i for r in between_lines(p, q, ["method"], ["i"], "lo", "hi").collect()}
    assert hit == {i for i, a, b in pairs if any(a <= x <= b for x in points)}
    free = {r.i for r in between_lines(p, q, ["method"], ["i"], "lo", "hi", anti=True).collect()}
    assert free == {i for i, _, _ in pairs} - hit
    near = near_lines(p.withColumnRenamed("lo", "line_a"), q.withColumnRenamed("line", "line_b"), 5, ["method"]).count()
    assert near == sum(abs(a - x) <= 5 for _, a, _ in pairs for x in points)


def test_ranked_numbers_a_hot_key_exactly(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 7}", i) for i in range(100)]
    random.Random(1).shuffle(rows)
    out = ranked(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"]).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.k, r.v)):
        by.setdefault(r.k, []).append(r.rn)
    assert all(v == list(range(1, len(v) + 1)) for v in by.values()) and len(by["hot"]) == 500


def test_graphs_of_few_edges_need_no_rounds(spark, monkeypatch):
    """Components and hit paths of small graphs went through rounds of joins; both ways give the same rows."""
    import random

    from taintgrid.operators import cycles, masks
    from taintgrid.operators import graph as G

    rnd = random.Random(7)
    edges = spark.createDataFrame([(g, rnd.randrange(8), rnd.randrange(8)) for g in range(25) for _ in range(rnd.randrange(1, 16))], "g int, src int, dst int")
    pairs = spark.createDataFrame([(g, rnd.randrange(9), rnd.randrange(9)) for g in range(27) for _ in range(6)], "g int, source int, target int")
    marks = spark.createDataFrame([(g, rnd.randrange(9)) for g in range(27) for _ in range(2)], "g int, node int")

    def rows():
        return (sorted(map(tuple, G.components(edges, ["g"]).collect())), sorted(map(tuple, G.all_paths_hit(edges, pairs, marks, ["g"]).collect())))

    def fail(*_):
        raise AssertionError("a round was made")

    with monkeypatch.context() as m:
        m.setattr(masks, "spread", fail)
        m.setattr(G, "contracted_components", fail)
        few = rows()
    with monkeypatch.context() as m:
        m.setattr(cycles, "SMALL", 10)  # graphs of more than five edges go through rounds
        mixed = rows()
    assert few == mixed and any(r[-1] for r in few[1]) and not all(r[-1] for r in few[1])
