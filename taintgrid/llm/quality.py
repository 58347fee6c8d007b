"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(score - cut[k]) with one weight vector over hashed words and text-form features and
ordered cuts, so that a text has one score, an expected grade and a tail probability. Fitted by Adagrad on at
most `rows` rated texts (those of the smallest hashes of doc_id); every text is scored.

Grades from `labels`: 0 for poor text, 1 for good but toxic text, 2 for good clean text; of several ratings
of a doc_id the lowest holds. Defined cases: null text is empty and has no word features; ratings with a null
are left out; with fewer than two grades nothing is fitted and every text gets tail probability 1; repeated
rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintgrid.llm import words as W

BITS = 16
ROWS = 12_000
GRADES = 3
TAIL = 0.5
FORMS = 14
SCALE = 20.0  # of word shares, so that one learning rate suits words and forms
LEAST_SHARE = 0.002  # of the rated texts that must hold a bucket for it to get a weight: rarer words only tell texts apart
_KIND = np.zeros((256, 6), np.float32)  # letters, capitals, digits, marks, line ends, bytes of other letters
_KIND[97:123, 0] = _KIND[65:91, 0] = _KIND[65:91, 1] = _KIND[48:58, 2] = _KIND[10, 4] = _KIND[128:, 5] = 1
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _KIND[_c, 3] = 1


@dataclass
class Model:
    weights: np.ndarray  # of hashed words
    forms: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    cuts: np.ndarray  # GRADES - 1, ascending


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: word buckets and their shares (all texts in a row), number of buckets, form features."""
    starts, ends, counts = W.spans(data, offsets)
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    key = (row.astype(np.uint64) << np.uint64(BITS)) | (W.hashes(data, starts, ends) >> np.uint64(64 - BITS))
    key, times = np.unique(key, return_counts=True)
    owner, bucket = (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int32)
    words = np.maximum(counts, 1)
    share = (times / words[owner]).astype(np.float32)
    size = np.maximum(np.diff(offsets), 1)
    form = np.zeros((n, FORMS), np.float32)
    kinds = _KIND[data]
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        form[full, :6] = np.add.reduceat(kinds, offsets[:-1][full], axis=0) / size[full, None]
    different = np.bincount(owner, minlength=n)
    length = np.bincount(row, weights=ends - starts, minlength=n) / words
    marked = np.bincount(row, weights=kinds[ends - 1, 3] if len(ends) else None, minlength=n) / words
    form[:, 6] = np.log1p(counts)
    form[:, 7] = different / words
    form[:, 8] = length
    form[:, 9] = marked
    form[:, 10] = np.bincount(row, weights=(ends - starts) == 1, minlength=n) / words
    top = np.zeros(n)
    np.maximum.at(top, owner, share)
    form[:, 11] = top
    form[:, 12] = counts == 0
    form[:, 13] = np.bincount(owner, weights=share.astype(float) ** 2, minlength=n)
    return bucket, share, np.bincount(owner, minlength=n), form


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    out = []
    for _, data, offsets in W.pieces(texts):
        bucket, share, n, form = features(data, offsets)
        own = np.repeat(np.arange(len(n)), n)
        out.append(np.bincount(own, weights=model.weights[bucket] * share, minlength=len(n)) + ((form - model.mean) / model.spread) @ model.forms)
    return np.concatenate(out) if out else np.zeros(0)


def fit(bucket: np.ndarray, share: np.ndarray, size: np.ndarray, form: np.ndarray, grade: np.ndarray, grades: int = GRADES, epochs: int = 12, least_steps: int = 1_000, batch: int = 128, rate: float = 2.0, ridge: float = 1e-6) -> Model:
    """Maximum likelihood by Adagrad; cuts stay ordered since each is the one below plus an exponential."""
    rng = np.random.default_rng(10)
    common = (np.bincount(bucket, minlength=1 << BITS) >= max(3, LEAST_SHARE * len(size)))[bucket]
    size = np.bincount(np.repeat(np.arange(len(size)), size)[common], minlength=len(size))
    bucket, share = bucket[common], share[common] * SCALE
    mean, spread = form.mean(0), form.std(0) + 1e-3
    form = (form - mean) / spread
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    f, f2 = np.zeros(form.shape[1]), np.full(form.shape[1], 1e-3)
    above = np.array([(grade >= k).mean() for k in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    cuts = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-2))
    c = np.concatenate([cuts[:1], gaps])
    c2 = np.full(len(c), 1e-1)
    at = np.cumsum(size) - size
    for _ in range(max(epochs, -(-least_steps * batch // max(1, len(grade))))):
        for rows in np.array_split(rng.permutation(len(grade)), max(1, len(grade) // batch)):
            idx = np.concatenate([np.arange(at[r], at[r] + size[r]) for r in rows]) if len(rows) else np.zeros(0, int)
            own, b, s = np.repeat(np.arange(len(rows)), size[rows]), bucket[idx], share[idx]
            cuts = np.concatenate([c[:1], c[0] + np.cumsum(np.exp(c[1:]))])
            score = np.bincount(own, weights=w[b] * s, minlength=len(rows)) + form[rows] @ f
            tail = 1 / (1 + np.exp(np.clip(cuts - score[:, None], -500, 500)))  # P(grade > k)
            full = np.concatenate([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))], 1)
            y = grade[rows]
            own_p = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-9)
            slope = full * (1 - full)
            up, down = slope[np.arange(len(y)), y] / own_p, slope[np.arange(len(y)), y + 1] / own_p
            d = -(up - down) / len(rows)
            gw = np.bincount(b, weights=d[own] * s, minlength=len(w)) + ridge * w
            hit = np.flatnonzero(gw)
            g2[hit] += gw[hit] ** 2
            w[hit] -= rate * gw[hit] / np.sqrt(g2[hit])
            gf = form[rows].T @ d + 1e-4 * f
            f2 += gf**2
            f -= rate * gf / np.sqrt(f2)
            by_cut = np.array([((y == k + 1) * up - (y == k) * down).sum() for k in range(grades - 1)]) / len(rows)
            gc = np.concatenate([[by_cut.sum()], [by_cut[k:].sum() * np.exp(c[k]) for k in range(1, grades - 1)]])
            c2 += gc**2
            c -= rate * gc / np.sqrt(c2)
    score = np.bincount(np.repeat(np.arange(len(size)), size), weights=w[bucket] * share, minlength=len(size)) + form @ f
    cuts = np.array([_level(score, (grade > k).sum()) for k in range(grades - 1)])
    return Model((w * SCALE).astype(np.float32), f, mean, spread, cuts)


def _level(score: np.ndarray, above: int) -> float:
    """The cut at which the tail probabilities of all rated texts sum to the number above it: the best fit of the cut
    for given scores, ordered as the numbers are."""
    low, high = score.min() - 50, score.max() + 50
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 / (1 + np.exp(np.clip(middle - score, -500, 500)))).sum() > above else (low, middle)
    return (low + high) / 2


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 poor, 1 good but toxic, 2 good and clean."""
    return labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.min(F.when(F.col("quality") == 0, 0).when(F.col("toxic") != 0, 1).otherwise(2)).alias("grade"))


def _pack(texts: pa.Array) -> pa.Array:
    out = []
    for _, data, offsets in W.pieces(texts):
        bucket, share, n, form = features(data, offsets)
        at = np.cumsum(n) - n
        out += [{"b": bucket[i : i + k].tobytes(), "s": share[i : i + k].tobytes(), "f": form[r].tobytes()} for r, (i, k) in enumerate(zip(at, n, strict=True))]
    return pa.array(out, pa.struct([("b", pa.binary()), ("s", pa.binary()), ("f", pa.binary())]))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model | None:
    """Fit on the rated texts of the `rows` smallest hashes of doc_id; None if fewer than two grades occur."""
    rated = grades(labels).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    few = F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    pack = F.arrow_udf(_pack, "struct<b:binary,s:binary,f:binary>")
    got = docs.select("doc_id", "text").join(few, "doc_id").select("doc_id", "grade", pack(F.col("text")).alias("x")).toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["x"]["b"]))
    if len({r["grade"] for r in got}) < 2:
        return None
    part = lambda k, kind: [np.frombuffer(r["x"][k], kind) for r in got]
    b, s, f = part("b", np.int32), part("s", np.float32), part("f", np.float32)
    return fit(np.concatenate(b), np.concatenate(s), np.array([len(x) for x in b]), np.stack(f), np.array([r["grade"] for r in got]))


def score_column(model: Model | None, grades: int = GRADES):
    """Struct of expected grade and of P(grade = best) for a text column; a function of a column."""

    def of(texts: pa.Array) -> pa.Array:
        tail = 1 / (1 + np.exp(np.clip(model.cuts - scores(model, texts)[:, None], -500, 500)))
        return pa.StructArray.from_arrays([pa.array(tail.sum(1)), pa.array(tail[:, -1])], ["grade", "tail"])

    if model is None:
        return lambda c: F.struct(F.lit(float(grades - 1)).alias("grade"), F.lit(1.0).alias("tail"))
    return F.arrow_udf(of, "struct<grade:double,tail:double>")


def classify(docs: DataFrame, labels: DataFrame, rows: int = ROWS, tail: float = TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the best grade) and selected (tail or more) of every row."""
    x = docs.select("doc_id", score_column(train(docs, labels, rows))(F.col("text")).alias("x"))
    return x.select("doc_id", F.col("x.grade").alias("expected_grade"), F.col("x.tail").alias("tail_probability"), (F.col("x.tail") >= tail).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, rows: int = ROWS, tail: float = TAIL) -> DataFrame:
    """The rows of docs whose text reaches the tail probability, unchanged."""
    return docs.where(score_column(train(docs, labels, rows))(F.col("text"))["tail"] >= tail)
