"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

Tokens are the words of `words` and one end per text. P(token) = P(class | context) * P(token | class, context). Classes are
the TOP most frequent tokens, one each, and the other words by form. A form's words are factored again, into at most SLOTS
classes of about equal counts, and so on down to single words, so a word costs a few small softmaxes and not one over all words of its form.
Each of these softmaxes sums weight rows of hashed context features, the word before, the two words before (n-gram) and the
second word before (skip), onto the logarithm of its classes' counts (c + 1 a word), which is the best fit of the bias feature alone.
The number of weight rows follows the number of different words. Each partition of the training texts runs gradient steps
(Adagrad) of all these softmaxes on all its tokens in sparse numpy batches, and Spark averages the partitions' rows by how
often each was touched.

Counts are taken over all training texts. Words frequent enough that at most `known` are as frequent go to
executors as one bounded table. Other words share leaves of their form by hash, each with 1 for an unseen word, and inside a
leaf P is (c + 1) / (sum of its c + 1); a text's other words meet their counts by a join on the word's hash.
Training texts: crc32(doc_id as text) mod 7 is not 2; a null doc_id counts as the empty text. Defined cases: null text is
empty and has its end only; repeated rows are scored, and counted, each; without training texts all counts are 0 and
classes are equally likely; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.llm import words as W
from taintgrid.session import checkpoint

TOP, FORMS = 5, 11
CLASSES = TOP + FORMS
SLOTS = 16  # classes of a softmax inside a form
FEATURES = 3
LEAST_ROWS, MOST_ROWS, WORDS_A_ROW = 1 << 12, 1 << 16, 256  # weight rows of a feature
LEAVES, WORDS_A_LEAF = 1 << 15, 16  # shared leaves of a form
ABSENT = np.float32(-1e30)  # log count of a slot without words
BATCH = 4096
RATE = 0.15
STRIP = 64  # weight rows that travel together
KNOWN = 1 << 20
END = np.int64(0x0E0D0F7E47)  # stands for the end of a text
_START = np.uint64(0x5D0C)


def training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 != 2


@dataclass
class Tokens:
    """All tokens of some texts in a row: key, form, and the text each belongs to."""

    key: np.ndarray
    form: np.ndarray
    row: np.ndarray
    counts: np.ndarray

    def contexts(self) -> list[np.ndarray]:
        """Hash of each feature of each token."""
        u = self.key.view(np.uint64)
        begin = np.cumsum(self.counts) - self.counts
        one, two = np.empty_like(u), np.empty_like(u)
        one[1:], two[2:] = u[:-1], u[:-2]
        two[:2] = one[:1] = _START
        one[begin] = two[begin] = _START
        after = begin[self.counts > 1] + 1
        two[after] = _START
        return [W.mix(one + np.uint64(1)), W.mix(one * np.uint64(0x9E3779B97F4A7C15) + two), W.mix(two + np.uint64(3))]


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    starts, ends, counts = W.spans(data, offsets)
    size = ends - starts
    heavy = np.concatenate([[0], np.cumsum((data >= 128) + ((data >= 48) & (data <= 57)) * (1 << 32), dtype=np.int64)])
    inside = heavy[ends] - heavy[starts]
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    letter = (last >= 128) | ((last | 32) >= 97) & ((last | 32) <= 122)
    form = np.select(
        [inside >> 32 > 0, last == ord("."), last == ord(","), ~letter, (inside & 0xFFFFFFFF) > 0, size <= 2, size == 3, size <= 5, size <= 8],
        [0, 1, 2, 3, 4, 5, 6, 7, 8], 9)
    total = counts + 1
    put = np.cumsum(total) - 1  # places of the ends
    n = int(total.sum())
    is_word = np.ones(n, bool)
    is_word[put] = False
    key, kinds = np.full(n, END, np.int64), np.full(n, FORMS - 1, np.int64)
    key[is_word], kinds[is_word] = W.hashes(data, starts, ends).view(np.int64), form
    return Tokens(key, kinds, np.repeat(np.arange(len(total)), total), total)


def token_counts(docs: DataFrame) -> DataFrame:
    """key, form, n of the tokens of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in W.pieces(batch.column(0), 4 << 20):
                t = tokens(data, offsets)
                key, first, n = np.unique(t.key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(t.form[first].astype(np.int32)), pa.array(n)], ["key", "form", "n"])

    rows = docs.where(training(F.col("doc_id"))).select("text").mapInArrow(count, "key bigint, form int, n bigint")
    return rows.groupBy("key").agg(F.min("form").alias("form"), F.sum("n").alias("n"))


@dataclass
class Tree:
    """Classes inside the forms. Leaves are numbered by form; each has its softmax and slot there, each softmax its own place above (-1: none)."""

    node: np.ndarray
    slot: np.ndarray
    up: np.ndarray
    up_slot: np.ndarray
    prior: np.ndarray  # natural logarithm of the share of each slot of each softmax


def tree(form: np.ndarray, mass: np.ndarray) -> Tree:
    """Leaves in descending mass are cut into SLOTS runs of about equal mass, and runs of several leaves again."""
    order = np.lexsort((-mass, form))
    cum = np.concatenate([[0], np.cumsum(mass[order])])
    bounds = np.searchsorted(form[order], np.arange(FORMS + 1))
    lo, hi = bounds[:-1], bounds[1:]
    up, up_slot = np.full(FORMS, -1), np.zeros(FORMS, np.int64)
    node, slot = np.full(len(form), -1, np.int32), np.zeros(len(form), np.uint8)
    found: list[tuple[np.ndarray, ...]] = []
    n = 0
    while True:
        keep = hi - lo > 1
        lo, hi, up, up_slot = lo[keep], hi[keep], up[keep], up_slot[keep]
        if not len(lo):
            break
        share = np.arange(1, SLOTS)
        cut = np.searchsorted(cum, cum[lo][:, None] + (cum[hi] - cum[lo])[:, None] * (share / SLOTS))
        cut = np.where((hi - lo <= SLOTS)[:, None], lo[:, None] + share, cut).clip(lo[:, None], hi[:, None])
        ends = np.column_stack([lo, cut, hi])
        part = np.diff(cum[ends], axis=1)
        prior = np.where(part > 0, np.log(np.maximum(part, 1) / part.sum(1, keepdims=True)), ABSENT)
        found.append((up, up_slot, prior))
        own, which = np.nonzero(np.diff(ends, axis=1) == 1)
        leaf = order[ends[own, which]]
        node[leaf], slot[leaf] = own + n, which
        own, which = np.nonzero(np.diff(ends, axis=1) > 1)
        lo, hi, up, up_slot = ends[own, which], ends[own, which + 1], own + n, which
        n += len(part)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SLOTS)))
    up, up_slot, prior = [np.concatenate(x) for x in zip(none, *found, strict=True)]
    return Tree(node, slot, up.astype(np.int32), up_slot.astype(np.uint8), prior.astype(np.float32))


@dataclass
class Model:
    key: np.ndarray  # frequent words, ascending as unsigned numbers, and one beyond the last
    n: np.ndarray
    form: np.ndarray
    leaf: np.ndarray  # of each frequent word; -1 for a class of its own
    first: np.ndarray  # place of the first key with each value of its upper bits
    top: np.ndarray  # keys that are a class each
    log_top: np.ndarray  # log10 of their c + 1
    shared: np.ndarray  # first shared leaf of each form, and one beyond the last
    log_shared: np.ndarray  # log10 of the counts of the shared leaves
    prior: np.ndarray  # natural logarithm of the share of each class
    tree: Tree
    weights: list[np.ndarray]  # of the classes and inside the forms: feature, row, class

    def classes(self, t: Tokens) -> np.ndarray:
        out = TOP + t.form
        order = np.argsort(self.top)
        if len(order):
            at = np.searchsorted(self.top[order], t.key).clip(max=len(order) - 1)
            hit = self.top[order][at] == t.key
            out[hit] = order[at[hit]]
        return out

    def find(self, t: Tokens, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of each token, -1 where it is not in the table; its leaf, -1 in a class of its own; log10 of the counts it shares its leaf with."""
        u, keys = t.key.view(np.uint64), self.key.view(np.uint64)
        at = self.first.take((u >> np.uint64(65 - len(self.first).bit_length())).astype(np.int64))
        behind = np.flatnonzero(keys.take(at) < u)
        while len(behind):
            at[behind] += 1
            behind = behind[keys.take(at[behind]) < u[behind]]
        hit = keys.take(at) == u
        n, leaf, log = np.where(hit, self.n.take(at), -1), np.where(hit, self.leaf.take(at), -1), np.zeros(len(u))
        other = np.flatnonzero((n < 0) & (own >= TOP))
        first = self.shared[t.form[other]]
        at = first + (t.key[other] & (self.shared[t.form[other] + 1] - first - 1))
        leaf[other], log[other] = len(self.key) - 1 + at, self.log_shared[at]
        alone = np.flatnonzero((n < 0) & (own < TOP))
        log[alone] = self.log_top[own[alone]]
        return n, leaf, log

    def steps(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The choices inside forms on the way to the leaves: place in `leaf`, softmax, slot."""
        at = np.flatnonzero(leaf >= 0)
        node, slot = self.tree.node[leaf[at]], self.tree.slot[leaf[at]]
        out = [(at[:0], node[:0], slot[:0])]
        while len(at):
            keep = node >= 0
            at, node, slot = at[keep], node[keep], slot[keep]
            out.append((at, node, slot))
            node, slot = self.tree.up[node], self.tree.up_slot[node]
        at, node, slot = [np.concatenate(x) for x in zip(*out, strict=True)]
        return at, node, slot

    def choices(self, t: Tokens, own: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
        """Batches of choices: level (0: class, 1: inside a form), tokens, weight rows, log shares, what was chosen."""
        hashes = t.contexts()
        at, node, slot = self.steps(leaf)
        mask = [np.uint64(w.shape[1] - 1) for w in self.weights]
        for lo in range(0, len(own), BATCH):
            y = own[lo : lo + BATCH]
            yield 0, np.arange(lo, lo + len(y)), [(h[lo : lo + BATCH] & mask[0]).astype(np.uint16) for h in hashes], self.prior, y
        for lo in range(0, len(at), BATCH):
            here, k = at[lo : lo + BATCH], node[lo : lo + BATCH]
            salt = (k.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            yield 1, here, [(((h.take(here) ^ salt) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & mask[1]).astype(np.uint16) for h in hashes], self.tree.prior.take(k, 0), slot[lo : lo + BATCH]


def _logits(w: np.ndarray, rows: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
    s = w[0].take(rows[0], 0)
    for k in range(1, FEATURES):
        s += w[k].take(rows[k], 0)
    s += prior
    return s


def _log_chosen(w: np.ndarray, rows: list[np.ndarray], prior: np.ndarray, y: np.ndarray, small: bool) -> np.ndarray:
    """`small`: no sum of weights is so large that its exponential is not a finite number."""
    s = _logits(w, rows, prior)
    if not small:
        s -= s.max(1, keepdims=True)
    return s[np.arange(len(y)), y].astype(np.float64) - np.log(np.exp(s).dot(np.ones(s.shape[1], np.float32)))


def _sums(r: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different weight rows and the sums of their gradients."""
    order = np.argsort(r, kind="stable")  # a radix sort, as rows are 16-bit numbers
    r = r[order]
    at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    n = np.diff(at, append=len(r))
    total = g.take(order.take(at), 0)
    many = np.flatnonzero(n > 1)
    if len(many):
        start = np.cumsum(n[many]) - n[many]
        total[many] = np.add.reduceat(g.take(order[np.repeat(n > 1, n)], 0), start, axis=0)
    return r[at].astype(np.intp), total


def _descend(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Gradient steps on a partition's tokens, of their class and of each choice inside their form; its weight rows, in strips, with how often each was touched."""
    weights = [np.zeros_like(w) for w in model.weights]
    squares, touches = [np.full(w.shape[:2], 1e-3, np.float32) for w in weights], [np.zeros(w.shape[:2], np.float32) for w in weights]
    for batch in batches:
        for _, data, offsets in W.pieces(batch.column(0)):
            t = tokens(data, offsets)
            own = model.classes(t)
            for level, _, rows, prior, y in model.choices(t, own, model.find(t, own)[1]):
                s = _logits(weights[level], rows, prior)
                g = np.exp(np.minimum(s, 80, out=s), out=s)
                g /= np.maximum(g.dot(np.ones(g.shape[1], np.float32)), 1e-30)[:, None]
                g[np.arange(len(y)), y] -= 1
                for w, g2, touched, r in zip(weights[level], squares[level], touches[level], rows, strict=True):
                    touched += np.bincount(r, minlength=len(touched))
                    hit, total = _sums(r, g)
                    square = g2.take(hit) + np.einsum("ij,ij->i", total, total) / g.shape[1]
                    g2[hit] = square
                    total *= (RATE / np.sqrt(square))[:, None]
                    w[hit] = w.take(hit, 0) - total
    first = 0
    for w, touched in zip(weights, touches, strict=True):
        w, touched = w.reshape(-1, STRIP, w.shape[2]), touched.reshape(-1, STRIP)
        for lo in range(0, len(w), 256):
            use = lo + np.flatnonzero(touched[lo : lo + 256].any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array((first + use).astype(np.int32)), pa.array([w[i].astype(np.float16).tobytes() for i in use], pa.binary()), pa.array([touched[i].tobytes() for i in use], pa.binary())],
                ["strip", "w", "touched"])
        first += len(w)


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strips' averages over the partitions, each row weighed by its touches; holds one sum a strip."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for strip, w, touched in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            n = np.frombuffer(touched, np.float32).astype(np.float64)
            part = np.frombuffer(w, np.float16).reshape(STRIP, -1)
            own = total.setdefault(strip, [np.zeros(part.shape), np.zeros(STRIP)])
            own[0] += part * n[:, None]
            own[1] += n
    for strip, (w, n) in total.items():
        mean = (w / np.maximum(n, 1)[:, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([strip], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["strip", "w"])


def train(docs: DataFrame, counts: DataFrame, known: int = KNOWN) -> Model:
    level = F.floor(F.log2("n") * 4).cast("int")
    by_level = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)  # some hundred rows
    least, total = 0, 0
    for at, n in by_level:
        total += n
        if total > known:
            least = at + 1
            break
    frequent = counts.where(level >= least).select("key", "n", "form").toArrow()
    best = counts.where(F.col("key") != int(END)).orderBy(F.desc("n"), "key").limit(TOP).collect()
    top = np.array([r.key for r in best], np.int64)
    other = counts.where((level < least) & ~F.col("key").isin([int(k) for k in top]))
    words = dict(other.groupBy("form").count().collect())  # one row a form
    size = [1 << min(max(words.get(form, 0) // WORDS_A_LEAF, 1) - 1, LEAVES - 1).bit_length() for form in range(FORMS)]
    shared = np.concatenate([[0], np.cumsum(size)])
    place = F.get(F.lit(shared[:-1].tolist()), F.col("form")) + F.col("key").bitwiseAND(F.get(F.lit([n - 1 for n in size]), F.col("form")).cast("long"))
    mass = np.ones(shared[-1])  # 1 for an unseen word in each
    of_leaf = other.groupBy(place.alias("leaf")).agg(F.sum(F.col("n") + 1).alias("m")).toArrow()  # at most FORMS * LEAVES rows
    mass[of_leaf["leaf"].to_numpy()] += of_leaf["m"].to_numpy()
    key, n, form = (frequent[c].to_numpy() for c in ("key", "n", "form"))
    order = np.argsort(key.view(np.uint64))
    key, n, form = key[order], n[order], form[order]
    bits = len(key).bit_length()
    upper = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    first = np.searchsorted(key.view(np.uint64), upper).astype(np.int32)
    alone = np.isin(key, top)
    # leaves: the frequent words, those with a class of their own last and left out, then the shared ones
    leaves = np.concatenate([form, np.repeat(np.arange(FORMS), size)])
    weight = np.concatenate([n + 1.0, mass])
    inside = np.flatnonzero(np.concatenate([~alone, np.ones(len(mass), bool)]))
    found = tree(leaves[inside], weight[inside])
    node, slot = np.full(len(leaves), -1, np.int32), np.zeros(len(leaves), np.uint8)
    node[inside], slot[inside] = found.node, found.slot
    found.node, found.slot = node, slot
    classes = np.ones(CLASSES)
    classes[: len(top)] = [r.n + 1 for r in best]
    classes[TOP:] = np.bincount(leaves[inside], weight[inside], FORMS)
    rows = 1 << (min(max(sum(n for _, n in by_level) // WORDS_A_ROW, LEAST_ROWS), MOST_ROWS) - 1).bit_length()
    model = Model(
        np.append(key, -1), np.append(n, -1), form, np.append(np.where(alone, -1, np.arange(len(key))), -1), first, top, np.log10(classes[: len(top)]), shared, np.log10(mass), np.log(classes / classes.sum()).astype(np.float32), found,
        [np.zeros((FEATURES, rows, width), np.float32) for width in (CLASSES, SLOTS)])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    steps = docs.where(training(F.col("doc_id"))).select("text").mapInArrow(lambda b: _descend(b, sent.value), "strip int, w binary, touched binary")
    mean = steps.repartition("strip").mapInArrow(_average, "strip int, w binary").toArrow()
    model.weights = [w.reshape(-1, STRIP * w.shape[2]) for w in model.weights]
    for strip, part in zip(mean["strip"].to_pylist(), mean["w"].to_pylist(), strict=True):
        level, strip = divmod(strip, len(model.weights[0]))
        model.weights[level][strip] = np.frombuffer(part, np.float32)
    model.weights = [w.reshape(FEATURES, rows, -1) for w in model.weights]
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Per text: tokens, known tokens and sum of log10(c + 1) as far as the table has them, terms of the choices, other words."""
    small = [np.abs(w).max((1, 2)).sum() < 80 for w in model.weights]
    for batch in batches:
        for first, data, offsets in W.pieces(batch.column("text")):
            t = tokens(data, offsets)
            n = len(t.counts)
            own = model.classes(t)
            c, leaf, log_leaf = model.find(t, own)
            terms = [(here, _log_chosen(model.weights[level], rows, prior, y, small[level])) for level, here, rows, prior, y in model.choices(t, own, leaf)]
            at, logs = [np.concatenate(x) for x in zip(*terms, strict=True)]
            term = np.bincount(at, logs, len(own)) / math.log(10) - log_leaf
            known = c > 0
            log_c = np.where(known, np.log10(np.maximum(c, 0) + 1.0), 0)
            rest = np.flatnonzero(~known)
            bounds = np.searchsorted(t.row[rest], np.arange(n + 1)).astype(np.int32)
            sums = [np.bincount(t.row, weights=x, minlength=n) for x in (known, log_c, term)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(first, n) for k in ("row", "doc_id", "held_out")), pa.array(t.counts.astype(np.int64)), pa.array(sums[0].astype(np.int64)),
                 pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(t.key[rest]))],
                ["row", "doc_id", "held_out", "n_tokens", "known", "log_c", "term", "rest"])


def score(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    counts = checkpoint(token_counts(docs))
    train_tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, counts, known))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), (~training(F.col("doc_id"))).alias("held_out"))
    part = checkpoint(rows.mapInArrow(
        lambda b: _score(b, sent.value), f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, log_c double, term double, rest array<bigint>"))
    rest = part.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("k"))
    met = rest.join(counts.select("key", "n"), "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("more"), F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("more_log"))
    out = part.drop("rest").join(met, "row", "left")
    more = F.coalesce("more_log", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("log_c") + more - F.col("n_tokens") * math.log10(train_tokens + distinct + 1)).alias("base_score"), (F.col("term") + more).alias("score"))
