"""Text operators against brute force, and their defined cases."""

import collections
import hashlib
import math
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from taintgrid.llm import bpe, jaccard, licenses, lm, mixing, packing, pii, quality
from taintgrid.llm import words as W
from tests.llm.conftest import DOCS


def low(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def cut(t):
    return [w for w in re.split("[ \t-\r]+", low(t or "")) if w]


def test_words_and_runs_do_not_depend_on_the_column_around_them():
    texts = [None, "", "A b  c\n d e f", " a", "x" * 3_000_000, "a b c d e", "Ärger Ärger\tA", *["".join(c * 3 for c in "ab \n"[: i % 5]) for i in range(50)]]
    seen = {}
    for first, data, offsets in W.pieces(pa.array(texts), 100):
        s, e, counts = W.spans(data, offsets)
        grams, own = W.grams(W.hashes(data, s, e), counts, 5)
        at = 0
        for i, k in enumerate(own):
            w = cut(texts[first + i])
            want = [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []
            assert k == len(want) and counts[i] == len(w)
            for a, b in zip(want, grams[at : at + k], strict=True):
                assert seen.setdefault(a, b) == b
            at += k
    assert len(set(seen.values())) == len(seen)


def classes_by_brute_force(rows):
    runs = []
    for _, t in rows:
        w = cut(t)
        runs.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    linked = [[False] * len(rows) for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            union = len(runs[i] | runs[j])
            same = (rows[i][1] or "") == (rows[j][1] or "")
            linked[i][j] = i != j and (same or (union > 0 and len(runs[i] & runs[j]) / union >= 0.8))
    part = list(range(len(rows)))
    for _ in rows:
        part = [min([part[i], *[part[j] for j in range(len(rows)) if linked[i][j]]]) for i in range(len(rows))]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        out.append((d, min(ids) if ids else None, sum(linked[i])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 4])
def test_jaccard_join(spark, odd, prose, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    df = spark.createDataFrame(prose, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(df).collect()), key=repr)
    assert got == classes_by_brute_force(prose)
    kept = jaccard.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c, _ in got})


def test_jaccard_defined_cases(odd, none):
    rows = [(d, t) for d, t, _, _ in DOCS]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(odd).collect()), key=repr)
    assert got == classes_by_brute_force(rows)
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, 7, 8, 9, None], key=repr)
    assert jaccard.jaccard_join(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_prefix_is_shortened_until_the_recall():
    d = jaccard.prefix_length(0.8, 20, 6, 0.9999)
    assert 1 - (1 - 0.8**d) ** 20 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 20
    with pytest.raises(ValueError):
        jaccard.prefix_length(0.8, 1, 6, 0.9999)


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_by_brute_force(t):
    out = []
    for k, rule in enumerate(BASE):
        for m in re.finditer(rule, t):
            d = re.sub("[^0-9]", "", m.group())
            good = [True, k == 1 and all(p.lstrip("0") in {"", *map(str, range(256))} for p in m.group().split(".")), 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    r = np.random.default_rng(4)
    bits = ["+", "1", "4111111111111111", "(", ")", " ", "-", ".", "@", "a", "x.y", "555-1234", "10.0.0.1", "é", "4111 1111 1111 1111", "2551", "\n"]
    for _ in range(30_000):
        t = "".join(r.choice(bits, r.integers(0, 12)))
        assert pii.base_spans(t) == base_by_brute_force(t), t


def test_long_digit_runs_and_many_addresses():
    assert pii.base_spans("0" * 5000 + "1.1.1.1") == [(0, 1, 5007)]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []
    every = pii.Boosted([np.array([0.5])] * 30, least=0.0)  # takes every candidate
    text = " ".join(f"see 10.0.{i % 256}.{i % 200} and 2691{i:06d} on" for i in range(60_000))
    import time

    began = time.monotonic()
    base, out = pii.spans(text, [None, every, every, every])
    assert len(base) == 60_000 and set(base) <= set(out) and len(out) > 60_000
    assert all(a[2] <= b[0] for a, b in zip(out, out[1:], strict=False))
    assert time.monotonic() - began < 90


def personal(spark):
    r = np.random.default_rng(9)
    def card():
        d = "45" + "".join(str(x) for x in r.integers(0, 10, 13))
        return next(d + str(c) for c in range(10) if pii.luhn(d + str(c)))
    rows = []
    for i in range(600):
        phone = f"+1 ({r.integers(200, 999)}) 555-{r.integers(1000, 9999)}"
        other = f"{r.integers(1, 9)}{r.integers(10**6, 10**9)}"
        between = " and then " if i % 10 else " "  # one in ten runs into its neighbour
        rows.append((i, f"text {other} goes {phone}{between}{card()} on, see {r.integers(0, 999)}.{r.integers(0, 999)}.3.4"))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


def test_boosting_adds_numbers_that_run_into_each_other(spark):
    df, rows = personal(spark)
    got = {r.doc_id: r for r in pii.find(df).collect()}
    added = 0
    for i, t in rows:
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_by_brute_force(t))
        assert got[i].base == base
        assert set(base.split(",")) <= set(got[i].spans.split(",")) or not base
        added += got[i].spans != base
        if i % 10:
            assert "text " not in t[: 0] and got[i].n_phone == 1
    assert added >= 30
    redacted = pii.redact(df).collect()
    assert sum("555-" in r.text for r in redacted) <= 10


def test_spellings_no_pattern_expresses_are_added_and_clean_texts_left_alone(spark):
    r = np.random.default_rng(31)
    pick = lambda *of: of[r.integers(0, len(of))]
    word = lambda: "".join(r.choice(list("aeioulnrst"), r.integers(3, 9)))
    prose = lambda: " ".join(word() for _ in range(r.integers(4, 12)))
    taught = [f"{prose()} {pick(word() + str(r.integers(9, 99)) + '@' + word() + '.com', f'+1 ({r.integers(200, 999)}) 555-{r.integers(1000, 9999)}')} {prose()}" for _ in range(400)]
    planted, clean = [], []
    for i in range(240):
        if i % 2:
            at, dot = pick((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "))
            s, kind = f"{word()}{pick('', '.', '_')}{word()}{at}{dot.join([word(), pick('org', 'net', 'de', 'com')])}", 0
        else:
            a, b, c = r.integers(200, 999), r.integers(200, 999), r.integers(1000, 9999)
            s, kind = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}"), 3
        before = prose() + " "
        planted.append((before + s + pick(" ", ", ", ". ") + prose().capitalize(), (len(before), kind, len(before) + len(s))))
        look = pick(f"{1990 + i % 30}/{1 + i % 12}/{1 + i % 28}", f"{1990 + i % 30}-{1 + i % 12:02}-{1 + i % 28:02}", f"no. {r.integers(10**8, 10**10)}", f"{word()} (at) {word()}",
                    f"{word()} @ {r.integers(1, 99)}.50", f"v{r.integers(0, 9)}.{r.integers(0, 99)}.{r.integers(0, 9999)}", f"pp. {100 + i}-{180 + i}", f"{i} 000 000")
        clean.append(f"{prose()} {look} {prose()}")
    rows = list(enumerate([*taught, *[t for t, _ in planted], *clean]))
    got = {x.doc_id: x for x in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {len(taught) + i: f"{pii.KINDS[k]}:{a}:{b}" for i, (_, (a, k, b)) in enumerate(planted)}
    added = [(i, s) for i, t in rows for s in set(got[i].spans.split(",")) - set(got[i].base.split(","))]
    right = sum(want.get(i) == s for i, s in added)
    assert right >= 0.95 * len(want) and right >= 0.98 * len(added), (right, len(added), len(want))
    for i, t in rows:
        assert got[i].base == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_by_brute_force(t))


def test_what_a_text_gives_the_sample_is_bounded():
    many = " ".join(f"u{i}@host{i}.org and +1 (269) 555-{1000 + i % 9000} or 9.9.9.{i}" for i in range(20_000))
    width = len(pii.describe("0", 0, 0, 1)) + 1
    got = np.array(pii._learn(pa.array([many, None, ""])).to_pylist()[0]).reshape(-1, width)
    assert 0 < len(got) < 400 and set(got[:, 0]) == {pii.NEGATIVE, pii.BASE, pii.REWRITTEN}
    assert len(pii.candidates("a at b dot " * 50_000)) >= 0


def test_personal_data_defined_cases(odd, none):
    got = pii.find(odd).collect()
    assert len(got) == len(DOCS)
    for r in got:
        texts = [t or "" for d, t, _, _ in DOCS if d == r.doc_id]
        assert r.base in [",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_by_brute_force(t)) for t in texts]
    assert pii.redact(odd).columns == odd.columns
    assert pii.find(none).count() == 0


def tokens_of(ranks, t):
    find = regex.compile(bpe.PATTERN).findall
    return [i for w in find(t or "") for i in bpe.merge_long(w.encode(), ranks)]


@pytest.mark.parametrize("known", [bpe.KNOWN, 5])
def test_bpe_round_trip(odd, known):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    whole = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(odd, known=known).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert (r.ids, bytes(r.decoded)) in [(whole.encode_ordinary(t or ""), (t or "").encode()) for d, t, _, _ in DOCS if d == r.doc_id]


def test_bpe_of_no_rows(none):
    assert bpe.round_trip(none).count() == 0


def test_words_are_cut_as_the_pattern_cuts_them():
    r = np.random.default_rng(6)
    bits = ["'", "'s", "'ll", "'re", " ", "  ", "\n", "a", "bc", "é", "1", "½", "!", "　", "\x85", "t", "D", "́", "😀", "_", "'d"]
    texts = ["".join(r.choice(bits, r.integers(0, 14))) for _ in range(30_000)]
    s = bpe.Slice(texts, bpe.PATTERN)
    words, at, find = [s.word(i) for i in range(len(s.start))], 0, regex.compile(bpe.PATTERN).findall
    for t, n in zip(texts, s.counts, strict=True):
        assert words[at : at + n] == find(t)
        at += n


@pytest.mark.parametrize("known", [lm.KNOWN, 3])
def test_language_model_base_scores(spark, odd, prose, known):
    for df, rows in ((spark.createDataFrame(prose, "doc_id bigint, text string"), prose), (odd, [(d, t) for d, t, _, _ in DOCS])):
        own = [(d, [*cut(t), "\0"], zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2) for d, t in rows]
        c = collections.Counter(w for _, t, held in own if not held for w in t)
        n, v = sum(c.values()), len(c)
        want = sorted((d or -1, held, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for d, t, held in own)
        got = lm.score(df, known).collect()
        assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 for r in got)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"{a}{k}" for k in r.integers(0, 5, 40) for a in ("x", "y", "z"))) for i in range(400)]  # after x comes y, then z
    got = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got) and len(got) > 20


def chain_texts(n):
    """Texts of 21 frequent words and, one after the other in a fixed order, 60 words of one form that are rarer."""
    r = np.random.default_rng(9)
    often, rare = [f"t{chr(97 + i)}" for i in range(21)], [f"m{chr(97 + i // 26)}{chr(97 + i % 26)}pqrs" for i in range(60)]
    out = []
    for i in range(n):
        at = r.integers(0, 60)
        out.append((i, " ".join([*r.choice(often, 30), *[rare[(at + k) % 60] for k in range(30)]])))
    return out, rare


@pytest.mark.parametrize("known", [lm.KNOWN, 30])
def test_words_of_one_form_follow_their_context(spark, known):
    rows, rare = chain_texts(500)
    held = [i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    shuffled = [rare[k * 17 % 60] for k in range(60)]  # the same words, none after its own
    rows += [(held[0], " ".join(rare)), (held[1], " ".join(shuffled))]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), known).where(F.col("doc_id").isin(held)).collect()}
    assert abs(got[held[0]].base_score - got[held[1]].base_score) < 1e-6
    assert got[held[0]].score > got[held[1]].score + 25  # 11 where context chooses forms only


def test_language_model_against_plain_loops(spark):
    rows, rare = chain_texts(60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts = lm.token_counts(docs)
    m = lm.train(docs, counts, 40)
    texts = ["ta tb", f"tc {rare[5]} {rare[6]} never", ""]
    t = lm.tokens(*W.text_bytes(pa.array(texts)))
    own = m.classes(t)
    _, leaf, log_leaf = m.find(t, own)
    hashes = t.contexts()
    masks = [w.shape[1] - 1 for w in m.weights]

    def softmax(level, i, node, prior):
        h = [int(x[i]) for x in hashes]
        if level:
            h = [(((x ^ ((node + 1) * 0x9E3779B97F4A7C15 % 2**64)) * 0xBF58476D1CE4E5B9) % 2**64) >> 40 for x in h]
        z = [float(p) + sum(float(m.weights[level][k][h[k] & masks[level]][c]) for k in range(3)) for c, p in enumerate(prior)]
        e = [math.exp(x) for x in z]
        return [x / sum(e) for x in e]

    def of_leaf(i, k):
        p, node, slot = 1.0, int(m.tree.node[k]), int(m.tree.slot[k])
        while node >= 0:
            p *= softmax(1, i, node, m.tree.prior[node])[slot]
            node, slot = int(m.tree.up[node]), int(m.tree.up_slot[node])
        return p

    want = np.zeros(len(texts))
    for i in range(len(t.key)):
        classes = softmax(0, i, 0, m.prior)
        want[t.row[i]] += math.log10(classes[own[i]] * (of_leaf(i, leaf[i]) if leaf[i] >= 0 else 1)) - log_leaf[i]
        whole = sum(classes[: lm.TOP])
        for form in range(lm.FORMS):
            inside = [k for k in range(len(m.form)) if m.leaf[k] >= 0 and m.form[k] == form] + [len(m.form) + k for k in range(m.shared[form], m.shared[form + 1])]
            whole += classes[lm.TOP + form] * sum(of_leaf(i, k) for k in inside)
        assert abs(whole - 1) < 1e-4
    ids = pa.array(range(len(texts)))
    part = pa.Table.from_batches(lm._score(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array([False] * len(texts)), pa.array(texts)], ["row", "doc_id", "held_out", "text"])]), m))
    assert np.allclose(part["term"].to_numpy(), want, atol=1e-3)


def test_language_model_of_no_rows(none):
    assert lm.score(none).count() == 0


def test_licences(spark, odd, none):
    rows = [(1, "Intro\nReleased under the  MIT licence? no.\nreleased UNDER the mit license!"), (2, "Licensed under CC BY-NC 4.0."), (3, "x\n\n"), (None, "Licensed under CC BY 4.0\nLicensed under CC BY 4.0"), (4, None)]
    got = {(r.doc_id, r.licence): (round(r.dice, 4), r.hits) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[(1, "MIT")] == (1.0, 1) and got[(2, "CC-BY-NC-4.0")][0] == 1.0 and got[(None, "CC-BY-4.0")][0] == 1.0
    assert not any(k[0] in (3, 4) for k in got)
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0 and licenses.scan(odd, []).count() == 0


def test_licences_in_passages(spark):
    """Wrapped, embedded, shortened, repeated and whole licences, which are no line of their own."""
    mit, short = licenses.TEMPLATES[3][1], licenses.TEMPLATES[0][1]
    gpl = dict(licenses.whole_texts())["GPL-3.0"]
    filler = " ".join(f"tok{i % 97}" for i in range(300))
    rows = [(1, textwrap.fill(mit, 72)), (2, f"{filler} {mit} {filler}"), (3, f"{filler} {short} {filler}\n{filler}"), (4, filler), (5, f"{filler} {' '.join(mit.split()[:48])} {filler}"),
            (6, f"{filler} {mit} {mit} {filler}"), (10, f"{filler}\n{gpl}\n{filler}"), *((20 + i, text) for i, (_, text) in enumerate(licenses.whole_texts()))]
    got = {(r.doc_id, r.licence): r.dice for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()}
    assert got[(1, "MIT")] == got[(2, "MIT")] == got[(3, "Apache-2.0")] == got[(6, "MIT")] == 1.0
    assert got[(5, "MIT")] >= 0.8 and got[(10, "GPL-3.0")] >= 0.95
    assert all(got[(20 + i, name)] == 1.0 for i, name in enumerate(licenses.WHOLE))
    assert {k[1] for k in got if k[0] < 10} == {"MIT", "Apache-2.0"} and not any(k[0] == 4 for k in got)


def test_mixing_reaches_target_weights(spark, odd, none):
    rows = [(i, "t", "a" if i % 10 else "b") for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.replicate(df, want).groupBy("source").count().collect()}
    # the third source has no rows, so its weight goes to the others
    assert abs(n["a"] - 10_000) < 500 and abs(n["b"] - 10_000) < 500
    assert mixing.replicate(df, want).repartition(3).exceptAll(mixing.replicate(df.repartition(5), want)).count() == 0
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(none).count() == 0
    assert mixing.mix(df, want.where("source = 'c'")).count() == 0


def test_mixing_of_a_rare_source_with_a_high_rate(spark):
    df = spark.createDataFrame([(i, "a" if i else None) for i in range(3000)], "doc_id bigint, source string")
    want = spark.createDataFrame([("a", 1.0), (None, 1.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.replicate(df, want).groupBy("source").count().collect()}
    assert abs(n[None] - 1500) < 250 and abs(n["a"] - 1500) < 250


def test_sharding(spark, odd, none):
    for df, shards in ((odd, 5), (spark.createDataFrame([(i, "x" * (i % 97) if i % 3 else "same text") for i in range(4000)], "doc_id bigint, text string"), 7)):
        got, rows = packing.assign(df, shards).collect(), df.select("doc_id", "text").collect()
        text = collections.Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == text
        slots = collections.defaultdict(list)
        groups = collections.defaultdict(set)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    for r in got:
        groups[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    load = collections.Counter()
    for r in got:
        load[r.shard] += r.size
    hot = max(load, key=load.get)  # the group of equal texts stands alone; the rest are near equal
    rest = [v for k, v in load.items() if k != hot]
    assert len(load) == 7 and max(rest) - min(rest) <= 0.02 * max(rest)
    assert packing.assign(none).count() == 0


def test_best_fit_decreasing_in_bulk_is_that_of_single_items():
    r = np.random.default_rng(1)
    for _ in range(50):
        items = sorted((int(x) for x in r.integers(1, 60, 200)), reverse=True)
        bins = []
        for s in items:
            fit = [(b, i) for i, b in enumerate(bins) if b >= s]
            if fit:
                bins[min(fit)[1]] -= s
            else:
                bins.append(100 - s)
        runs, used = packing.pack([(s, s, n) for s, n in sorted(collections.Counter(items).items(), reverse=True)], 100)
        left = [100] * used
        for run in runs:
            left[run.bin] -= run.kind * (run.last - run.first)
        assert sorted(left) == sorted(bins)


def graded(n):
    r = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        kind = i % 3
        text = [str(r.choice(words)) for _ in range(80)]
        if kind == 0:
            text = [w + "$$$" for w in text]
        if kind == 1:
            text[:: 12] = ["rude"] * len(text[::12])
        docs.append((i, " ".join(text)))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return docs, labels


def test_quality_on_held_out_ratings(spark):
    docs, labels = graded(900)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rated = spark.createDataFrame(labels[:600], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, rated).collect()}
    held = range(600, 900)
    assert sum(got[i].selected == (i % 3 == 2) for i in held) >= 0.97 * 300
    means = [np.mean([got[i].expected_grade for i in held if i % 3 == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert {r.doc_id for r in quality.keep_selected(df, rated).collect()} == {i for i, r in got.items() if r.selected}


def test_quality_defined_cases(spark, odd, none):
    no_ratings = spark.createDataFrame([(1, None, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(odd, no_ratings).collect()
    assert len(got) == len(DOCS) and all(r.selected for r in got)
    some = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 1, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.grades(some).collect()} == {1: 0, 2: 0, 3: 2, 4: 1, 5: 2}
    assert quality.classify(odd, some).count() == len(DOCS)
    assert quality.keep_selected(odd, some).columns == odd.columns
    assert quality.classify(none, some).count() == 0


def test_query_digests(spark, odd):
    from taintgrid.llm.queries import token_digests

    got = token_digests(bpe.round_trip(odd.where("doc_id = 3"))).collect()[0]
    ids = bpe.encode(odd.where("doc_id = 3")).collect()[0].ids
    assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got.decoded_sha256 == hashlib.sha256(b"Hello, world").hexdigest() and got.n_tokens == len(ids)
