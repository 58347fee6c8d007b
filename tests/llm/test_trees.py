"""Merkle manifest, prefix trie and multiset fingerprints against plain Python, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from taintgrid.llm import merkle, multiset, trie
from taintgrid.llm.shared import table

COLS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def documents(n=90):
    r = random.Random(7)
    rows = [(i, f"text {i} é" * (i % 4), r.choice(["en", "en", "en", "fr", "", None]), r.choice(["a", None]), r.choice([None, i])) for i in range(n)]
    return rows + [(None, None, None, None, None)] * 2 + [(3, "", "en", "", None)] * 2 + [(7, "same id", "fr", "b", 2**63 - 1)]


def manifest_by_hand(rows, fanout):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, la, s, n: h("".join(map(enc, (d, s, la, n, t))))

    def build(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def beside(levels, i):
        out = []
        for level in levels[:-1]:
            first = i - i % fanout
            run = level[first : first + fanout]
            out.append(("".join(run[: i - first]), "".join(run[i - first + 1 :])))
            i //= fanout
        return out

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row, leaf(*row)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {g: build([d for _, d in groups[g]]) for g in langs}
    top = build([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, ((d, t, la, s, n), own) in enumerate(groups[g]):
            path = beside(trees[g], i) + beside(top, k)
            hit = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
            cur = leaf(d, t, la, s, n + 1 if hit else n)
            for before, after in path:
                cur = h(before + cur + after)
            out.append((d, own, trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in path)), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fanout", "n"), [(2, 90), (3, 30), (2, 0)])
def test_manifest_with_ties_nulls_and_repeated_rows(spark, fanout, n):
    rows = documents(n)
    got = sorted((tuple(r) for r in merkle.check_rows(spark.createDataFrame(rows, COLS), fanout).collect()), key=repr)
    assert got == manifest_by_hand(rows, fanout)
    if n == 90:
        assert 0 < sum(not r[-1] for r in got) < n / 3


def test_manifest_of_one_row_and_of_none(spark):
    one = [(1, "x", None, None, 1)]
    df = spark.createDataFrame(one, COLS).selectExpr("*", "'clash' as g", "'clash' as place", "'clash' as digest", "'clash' as path")
    assert [tuple(r) for r in merkle.check_rows(df).collect()] == manifest_by_hand(one, 2)
    assert merkle.check_rows(df.where("false")).count() == 0


def trie_by_hand(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((t is not None, t or 0), tie, role, text))
    convs = {c: [x[2:] for x in sorted(own)] for c, own in convs.items()}
    whole = {}
    for c, own in convs.items():
        k = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(convs.get(base, [])[:k] + own[k:])
    members, kids = {}, {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    for x in members:
        if x:
            kids.setdefault(x[:-1], []).append(x)
    leaves, saved = Counter(), Counter()
    for x in members:
        own = (len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", x[-1][1])) if x else 0
        for d in range(len(x) + 1):
            saved[x[:d]] += own
            leaves[x[:d]] += x not in kids
    return sorted((
        (min(m), len(x), min(members[x[:-1]]) if x else None, len(m), len(kids.get(x, [])), leaves[x], saved[x],
         h(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(x)))) for x, m in members.items()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_trie_of_odd_deep_and_hot_conversations(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(trie, "BLOCK", 7)
        monkeypatch.setattr(trie, "CHUNK", 3)
    r = random.Random(3)
    rows = [(r.choice([None, -45, -20, -3, 0, 1, 2, 3, 5, 20, 21, 22, 40]), r.choice([None, 1, 1, 2, 3]), r.choice([None, "u", "a"]), r.choice([None, "", "x", "x y\tz"])) for _ in range(120)]
    rows += [(100, i, "u", f"word {i}") for i in range(150)] + [(c, i, "u", f"word {i}") for c in (101, 120) for i in range(120)]
    rows += [(c, i, "u", f"q {i}") for c in range(200, 260) for i in range(3)] + [(300, 1, "a", "long " * 50_000)] + rows[:5]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.selectExpr("*", "1 as node", "2 as p", "3 as h", "'x' as parent")
    assert sorted((tuple(x) for x in trie.prefix_trie(df).collect()), key=repr) == trie_by_hand(rows)
    assert trie.prefix_trie(df.where("false")).count() == 0


def test_contraction_takes_few_rounds_on_a_chain(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(trie, "checkpoint", lambda df, real=trie.checkpoint: seen.append(1) or real(df))
    n = 700
    chain = spark.range(n).selectExpr("cast(id as string) n", "id").selectExpr(
        "cast(n as binary) node", "case when id > 0 then cast(cast(id - 1 as string) as binary) end parent", "id depth",
        f"cast(if(id < {n - 1}, 1, 0) as bigint) kids", "id v")
    got = {int(r.node): r.v for r in trie.subtree_sums(chain, ["v"]).collect()}
    assert got == {i: sum(range(i, n)) for i in range(n)}
    assert len(seen) < 4 * 25


def test_fingerprints(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    edited = {}
    for i, (d, t) in enumerate(rows):
        q = len(t) // 4
        edited[d] = t[: len(t) - q] + rows[(i + 1) % len(rows)][1][:q]
    got = {r.doc_id: r for r in multiset.compared(docs).collect()}
    direct = multiset.vectors(spark.createDataFrame(list(edited.items()), "doc_id bigint, text string"), ["doc_id"], "text")
    whole = {r.doc_id: r.f for r in direct.select("doc_id", multiset.written(F.col("v")).alias("f")).collect()}
    pieces = lambda t: Counter(x for p in t.split("\n") for x in re.split(r"(?<=[^\w\s])\s+", p))
    apart = []
    for i, (d, t) in enumerate(rows):
        assert got[d].edited_sha256 == h(edited[d]) and got[d].n_chars == len(t)
        assert got[d].edited_fingerprint == whole[d]  # taken out and put in, not read anew
        for near, other in ((got[d].near_edited, edited[d]), (got[d].near_next, rows[(i + 1) % len(rows)][1])):
            a, b = pieces(t), pieces(other)
            apart.append(near - 2 * sum(a[k] * b[k] for k in a) / (sum(v * v for v in a.values()) + sum(v * v for v in b.values())))
    assert len(got) == len(rows) and max(map(abs, apart)) < 0.35 and sum(x * x for x in apart) / len(apart) < 0.07**2


def test_fingerprints_defined_cases(spark, odd, none):
    texts = ["a\nb c\n\na", "b c\na\na\n", "a\nb", "a\na", "c", "c\nb\na", "a\nb\nc", "b\nc", "a"]
    vectors = multiset.vectors(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"], "text")
    one = vectors.groupBy().pivot("i", list(range(len(texts)))).agg(F.first("v")).select(*[F.col(str(i)).alias(f"v{i}") for i in range(len(texts))])
    one = one.select(
        F.expr("v0 = v1").alias("order"), F.expr("v2 = v3").alias("repeats"), (multiset.plus(F.col("v2"), F.col("v4")) == F.col("v5")).alias("put_in"),
        (multiset.minus(F.col("v6"), F.col("v7")) == F.col("v8")).alias("taken_out"), multiset.likeness(F.col("v8"), F.col("v8")).alias("same")).first()
    assert (one.order, one.repeats, one.put_in, one.taken_out, one.same) == (True, False, True, True, 1.0)
    got = multiset.compared(odd).collect()
    assert len(got) == odd.count() and all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    by_text = {}
    for r in got:
        if r.doc_id is not None:
            by_text.setdefault(r.doc_id, set()).add((r.fingerprint, r.near_edited, r.near_next, r.edited_sha256))
    assert len(by_text[5]) == 1  # repeated rows
    assert by_text[9].pop()[0] == by_text[10].pop()[0]  # equal texts
    assert multiset.compared(none).count() == 0
    single = multiset.compared(spark.createDataFrame([(1, "only one here")], "doc_id bigint, text string")).first()
    assert single.near_next == 1.0 and single.edited_sha256 == h("only one h" + "onl")
