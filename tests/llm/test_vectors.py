"""Vector operators against brute force, and their defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taintgrid.llm import itq, nearest
from taintgrid.llm.shared import components

SCHEMA = "vec_id bigint, embedding array<float>, label int, keys string, dim string, rank int"


def clustered(n, dim=24, seed=5):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 3, dim))
    x = base[r.integers(0, len(base), n)] + r.standard_normal((n, dim)) * r.choice([0.02, 0.15, 0.35], (n, 1))
    x[: n // 4] = base[0] + r.standard_normal((n // 4, dim)) * 0.05  # one large group
    return x.astype(np.float32)


def frame(spark, x, odd=True):
    rows = [(i, [float(v) for v in row], 0, "k", "d", 1) for i, row in enumerate(x)]
    if odd:
        n = len(rows)
        rows += [(n, None, 0, "k", "d", 1), (n + 1, [], 0, "k", "d", 1), (n + 2, [0.0] * x.shape[1], 0, "k", "d", 1), (n + 3, [float("nan")] * x.shape[1], 0, "k", "d", 1),
                 (n + 4, [None] + [1.0] * (x.shape[1] - 1), 0, "k", "d", 1), (n + 5, [1.0, 2.0], 0, "k", "d", 1), (None, [1.0] * x.shape[1], 0, "k", "d", 1), rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


def cosines(x):
    x = x.astype(float)
    return (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)


@pytest.mark.parametrize("block", [nearest.BLOCK, 64])
def test_nearest_recall(spark, block):
    x = clustered(700)
    got = nearest.neighbours(frame(spark, x), F.col("vec_id") % 10 == 0, block=block, queries=30).collect()
    c = cosines(x)
    np.fill_diagonal(c, -9)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, 700, 10):
        own = sorted(found[q])
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5]
        assert all(abs(s - c[q, v]) < 1e-12 for _, v, s in own)
        assert own == [(i + 1, v, s) for i, (_, v, s) in enumerate(sorted(own, key=lambda z: (-z[2], z[1])))]
        hit += len({v for _, v, _ in own} & set(np.argsort(-c[q], kind="stable")[:5].tolist()))
    assert hit / 350 >= 0.95


def test_nearest_ties_few_and_none(spark):
    x = np.ones((9, 4), np.float32)
    got = nearest.neighbours(frame(spark, x, False), F.col("vec_id") == 4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 5]
    got = nearest.neighbours(frame(spark, x[:3], False), F.col("vec_id") == 1).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 2]
    assert nearest.neighbours(frame(spark, x, False).where("false"), F.col("vec_id") == 1).count() == 0


def test_nearest_gives_all_vectors_where_there_are_fewer_than_k():
    r = np.random.default_rng(4)
    for q in r.standard_normal((3000, 1, 3)):
        i, j, score = nearest.search(np.array([1, 2]), np.concatenate([-q, -q + 0.01]), np.array([9]), q, 5)
        assert sorted(j.tolist()) == [0, 1] and (i == 0).all() and (score < -0.9).all()


@pytest.mark.parametrize("block", [itq.BLOCK, 50])
def test_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", block)
    x = clustered(600)
    df = frame(spark, x)
    got = {r.vec_id: r for r in itq.near_copies(df).collect()}
    assert sorted(got) == list(range(606))
    link = cosines(x) >= 0.9
    np.fill_diagonal(link, False)
    n = np.array([got[i].n_links for i in range(600)])
    assert (n <= link.sum(1)).all() and n.sum() >= 0.95 * link.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(600, 606))
    part = np.arange(600)
    for _ in range(600):
        new = np.minimum(part, np.where(link, part[None, :], 10**6).min(1))
        if (new == part).all():
            break
        part = new
    assert np.mean([got[i].component_id == part[i] for i in range(600)]) >= 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in range(606))


def test_near_copies_with_a_shared_mean(spark):
    """All vectors share a mean of length 0.8; pairs of cosine 0.90 to 0.93."""
    r = np.random.default_rng(3)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    u, v = unit(r.standard_normal((1500, 31))), unit(r.standard_normal((1500, 31)))
    c = r.uniform(0.725, 0.80, (1500, 1))
    v = c * u + np.sqrt(1 - c * c) * unit(v - (v * u).sum(1, keepdims=True) * u)
    x = np.concatenate([np.full((3000, 1), 0.8), 0.6 * np.concatenate([u, v])], 1).astype(np.float32)
    link = cosines(x) >= 0.9
    np.fill_diagonal(link, False)
    got = {q.vec_id: q.n_links for q in itq.near_copies(frame(spark, x, False)).collect()}
    assert link.sum() >= 2900 and sum(got.values()) >= 0.97 * link.sum()
    for n in (20_000, 10_000_000):
        coder = itq.learn(x.astype(float), n, 0.9, 0.98)
        a, b = coder.keys(x[:1500].astype(float)), coder.keys(x[1500:].astype(float))
        assert (a == b).any(1).mean() >= 0.97


def test_near_copies_of_nothing(spark):
    df = frame(spark, np.ones((3, 4), np.float32), False)
    assert itq.near_copies(df.where("false")).count() == 0
    assert {r.vec_id: (r.n_links, r.component_id) for r in itq.near_copies(df).collect()} == {0: (2, 0), 1: (2, 0), 2: (2, 0)}


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(3000)] + [(5000, 5000 + i) for i in range(1, 500)] + [(7000, 7000), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(3001)) and all(got[5000 + i] == 5000 for i in range(500)) and 7000 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
