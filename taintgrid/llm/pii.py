"""Personal data by candidate gradient boosting.

Base spans of four kinds are found by fixed patterns and checks and always stay. Beside them, generators of
high recall propose overlapping spans; boosted trees score each by its format and context; a threshold per
kind, calibrated on held-out texts, selects which are added. The trees learn from at most `rows` texts (those of
the smallest hashes of doc_id), at most SHOWN candidates and TAUGHT rewritten spans of each, from three sources:
* Base spans are positive. So a number that a fixed pattern loses because it runs into its neighbour, as a phone
  number followed by a card number does, is still proposed on its own and judged by its looks.
* Each e-mail and phone span is also rewritten, in its own context, into spellings the fixed patterns cannot
  express ("name (at) host (dot) com", a national phone number). The rewritten span is positive; other candidates
  that overlap it (parts of it, or it with a neighbour) are negative, and so are look-alikes put in its place
  (dates, versions, serial numbers, "at" between two words of the text).
* Addresses out of range, numbers that fail the check digit and single runs of digits are negative. Candidates in
  formats that the fixed patterns cannot express have no label.
Where a kind has rewritten spans, its threshold is calibrated on rewritten spans and negatives alone, so that easy
base spans do not hide wrong additions.

Positions are code points, ends exclusive. Defined cases: null text is empty and has no spans; repeated rows get
equal results; with no positive or no negative candidate nothing is added; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ROWS = 20_000
SHOWN, TAUGHT = 64, 2  # labelled candidates, and spans rewritten, of a text of the sample; evenly spread over it
PRECISION = 0.98  # of the candidates above a threshold, on held-out texts
LEAST = 10  # held-out candidates that must stand above a threshold
NEGATIVE, BASE, REWRITTEN = 0, 1, 2  # labels
TREES, LEVELS, BINS, RATE = 40, 3, 32, 0.2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match always begins a run of digits
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")  # shorter runs fail the check of 12 digits anyway
_MAILISH = re.compile(r"[\w.%+-]{1,64} ?(?:@|[\[(] ?at ?[\])]) ?[\w-]{1,64}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[\w-]{1,64}){0,4}")
_AT = re.compile(r"[\[(] ?at ?[\])]")
_SPOKEN = re.compile(r"[\w.%+-]{1,64} at [\w-]{1,64}(?: dot [\w-]{1,64}){1,4}")
_PART = re.compile(r" ?(?:\.|[\[(] ?dot ?[\])]) ?| dot ")  # between the parts of a host
_WRITTEN = re.compile(r" at | dot |[\[(] ?(?:at|dot) ?[\])]")
_ENDINGS = {w: i + 1 for i, w in enumerate(("com", "org", "net", "edu", "gov", "info", "io", "eu", "uk", "de", "fr", "es", "it", "us"))}
_AREA = re.compile(r"[0-9][0-9 .()-]{6,}")  # any address, card or phone number lies in one such run, but for a phone's +
_NO_SPACE = re.compile(r"[^ ]+")
TOKENS = 6  # of a number-like run, parted by spaces, that a candidate may span
_WORD_BEFORE = re.compile(r"(\w+)\W{0,3}$")
_CUES = {w: i + 1 for i, w in enumerate(("tel", "phone", "call", "fax", "mobile", "mail", "email", "contact", "ip", "host", "server", "card", "visa", "iban", "id", "version", "page"))}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):  # each address has one @, so it is found from there
            i = at = m.start()
            while i > last and text[i - 1] in _LOCAL:
                i -= 1
            if i < at:
                out.append((i, 0, m.end()))
                last = m.end()
    for area in _AREA.finditer(text):
        lo, hi = area.span()
        for m in _IP.finditer(text, lo, hi):
            if all(len(d) <= 3 and int(d or "0") <= 255 for d in (p.lstrip("0") for p in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, lo, hi):
            d = _digits(m.group())
            if len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if lo and text[lo - 1] == "+":  # a run holds no other +, and its phone number goes to its last digit
            end = lo + len(area.group().rstrip(" .()-"))
            if 9 <= len(_digits(text[lo:end])) <= 15:
                out.append((lo - 1, 3, end))
    out.sort()
    return out


def _hosts(text: str, c: re.Match, at: int, out: set[tuple[int, int, int]]) -> None:
    """A mail-like match with each number of host parts, as a sentence may go on where the host ends."""
    for m in _PART.finditer(text, at + 1, c.end()):
        if m.start() > at:
            out.add((c.start(), 0, m.start()))
    out.add((c.start(), 0, c.end()))


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Proposed (start, kind, end): mail-like spans, and number-like spans once for each number kind."""
    out: set[tuple[int, int, int]] = set()
    signs = [i for i, c in enumerate(text) if c == "@"] if "@" in text else []
    if "at)" in text or "at]" in text or "at ]" in text or "at )" in text:
        signs += [m.start() for m in _AT.finditer(text)]
    for at in signs:
        for c in _MAILISH.finditer(text, max(0, at - 66), min(len(text), at + 300)):
            if c.start() <= at < c.end():
                _hosts(text, c, at, out)
                break
    if " dot " in text:
        for c in _SPOKEN.finditer(text):
            _hosts(text, c, text.index(" at ", c.start()) + 1, out)
    for m in _AREA.finditer(text):
        i = m.start()
        while i > 0 and m.start() - i < 2 and text[i - 1] in "+(":
            i -= 1
        parts = [t.span() for t in _NO_SPACE.finditer(text, i, m.end())]
        for a in range(len(parts)):
            for b in range(a, min(len(parts), a + TOKENS)):
                start, end = parts[a][0], parts[b][1]
                end -= len(text[start:end]) - len(text[start:end].rstrip(".()-"))
                if end - start >= 7 and not text[start - 1 : start].isalnum() and not text[end : end + 1].isalnum():
                    out.update((start, kind, end) for kind in (1, 2, 3))
    return sorted(out)


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format, check digits and context of a candidate."""
    s = text[start:end]
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    cue = _WORD_BEFORE.search(before)
    p, q = before[-1:], after[:1]
    sort = lambda c: 0 if not c else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4
    tail = s.rpartition(".")[2]
    return [
        kind, len(s), sum(groups), len(groups), max(groups, default=0), min(groups, default=0),
        s.count(" "), s.count("."), s.count("-"), s.count("("), s.count("/"), s[0] == "+", s[0] == "(",
        "@" in s, len(tail), tail.isalpha(), len(set(s)) / len(s), sort(p), sort(q), p == "+", q == ".",
        _CUES.get(cue.group(1).lower(), 0) if cue else 0, sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        sum(c.isalpha() for c in before), before.rstrip()[-1:] in (":", "="), groups[0] if groups else 0, groups[-1] if groups else 0,
        0 < sum(groups) <= 19 and luhn(_digits(s)), bool(groups) and all(g <= 3 for g in groups) and all(int(v) <= 255 for v in re.findall("[0-9]+", s)),
        len(_WRITTEN.findall(s)), len(_PART.findall(s)), bool(_PART.match(after)), _ENDINGS.get(_PART.split(s)[-1].lower(), 0),
        groups[1] if len(groups) > 1 else 0, groups[-2] if len(groups) > 1 else 0, before.rstrip()[-1:].isdigit(), after.lstrip()[:1].isdigit(),
    ]


@dataclass
class Boosted:
    """Boosted trees over binned features for one kind, with a logistic calibration and a threshold."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf values
    start: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    least: float = np.inf

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], 1).astype(np.int16)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(bins), np.int64)
            for _ in range(LEVELS):
                at = 2 * at + 1 + (bins[np.arange(len(bins)), feature[at]] > cut[at])
            out += leaf[at - (2**LEVELS - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(self.binned(x)) + self.shift)))


Models = list[Boosted | None]


def boost(x: np.ndarray, label: np.ndarray, held: np.ndarray) -> Boosted | None:
    """Fit trees on rows that aren't held, calibrate and choose the threshold on those that are."""
    y = label > 0
    if not len(x) or len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        return None
    model = Boosted([np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T])
    bins = model.binned(x)
    own, z = bins[~held], y[~held].astype(float)
    model.start = float(np.log(z.mean() / (1 - z.mean())))
    raw = np.full(len(z), model.start)
    width = BINS + 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = z - p, p * (1 - p)
        feature, cut = np.zeros(2**LEVELS - 1, np.int64), np.full(2**LEVELS - 1, width, np.int64)
        at = np.zeros(len(z), np.int64)
        for level in range(LEVELS):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for f in range(own.shape[1]):
                key = (at - first) * width + own[:, f]
                gs = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(1)
                hs = np.bincount(key, h, nodes * width).reshape(nodes, width).cumsum(1)
                gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                k = gain.argmax(1)
                up = gain[np.arange(nodes), k]
                better = up > best
                best[better] = up[better]
                feature[first : first + nodes][better], cut[first : first + nodes][better] = f, k[better]
            at = 2 * at + 1 + (own[np.arange(len(z)), feature[at]] > cut[at])
        leaves = at - (2**LEVELS - 1)
        leaf = RATE * np.bincount(leaves, g, 2**LEVELS) / (np.bincount(leaves, h, 2**LEVELS) + 1)
        raw += leaf[leaves]
        model.trees.append((feature, cut, leaf))
    score, target = model.raw(bins[held]), y[held].astype(float)
    smooth = np.where(target > 0, (target.sum() + 1) / (target.sum() + 2), 1 / ((1 - target).sum() + 2))  # finite where all are apart
    for _ in range(200):  # logistic calibration by Newton steps
        p = 1 / (1 + np.exp(-(model.slope * score + model.shift)))
        d, w = smooth - p, np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[w @ score**2 + 1e-3, w @ score], [w @ score, w.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([d @ score, d.sum()]))
        model.slope, model.shift = model.slope + float(step[0].clip(-1, 1)), model.shift + float(step[1].clip(-1, 1))
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-(model.slope * score + model.shift)))
    if (label[held] == REWRITTEN).any():
        judged = label[held] != BASE
        p, target = p[judged], target[judged]
    order = np.argsort(-p, kind="stable")
    good = target[order].cumsum() / np.arange(1, len(order) + 1)
    ends = np.append(np.diff(p[order]) != 0, True)
    fits = np.flatnonzero(ends & (p[order] >= 0.5) & (good >= PRECISION) & (np.arange(1, len(order) + 1) >= LEAST))
    if len(fits):
        last = p[order][fits[-1]]
        below = p[p < last]
        model.least = max(0.5, float((last + below.max()) / 2)) if len(below) else float(last)
    return model


def boost_kinds(x: np.ndarray, label: np.ndarray, held: np.ndarray) -> Models:
    """One model a kind, since a span is proposed once for each number kind and looks decide differently for each."""
    return [boost(x[x[:, 0] == k], label[x[:, 0] == k], held[x[:, 0] == k]) for k in range(len(KINDS))]


def _unknown(text: str, c: tuple[int, int, int]) -> bool:
    """A candidate in a format that the fixed pattern of its kind cannot express."""
    start, kind, end = c
    s = text[start:end]
    grouped = len(re.findall("[0-9]+", s)) > 1 and len(_digits(s)) <= 15
    return kind == 0 or (kind == 3 and s[0] != "+" and grouped)


def labelled(text: str) -> list[tuple[tuple[int, int, int], int]]:
    """Candidates of a text with their label; those that would be a base span if they stood alone, and those in
    formats no fixed pattern expresses, have none and are left out."""
    base = set(base_spans(text))
    out = []
    for c in candidates(text):
        if c in base:
            out.append((c, BASE))
        elif not _unknown(text, c) and (0, c[1], c[2] - c[0]) not in base_spans(text[c[0] : c[2]]):
            out.append((c, NEGATIVE))
    return out


_SPELLINGS = ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", " . "), (" (at) ", "."), ("[at]", "."))


def _words(before: str, after: str) -> list[str]:
    """Three words from around a span."""
    found = re.findall(r"[A-Za-z]+", before)[-2:] + re.findall(r"[A-Za-z]+", after)[:2]
    return (found + ["meet", "home", "then"])[:3]


def rewritten(kind: int, s: str, before: str, after: str) -> list[str]:
    """Spellings of an e-mail or phone span that no fixed pattern expresses; of mails also with a name and host
    made of the words around, so that not only names like the sample's are learnt."""
    if kind == 0:
        name, _, host = s.rpartition("@")
        one, two, three = _words(before, after)
        ends = list(_ENDINGS)
        out = []
        for i, (at, dot) in enumerate(_SPELLINGS):
            end = ends[(len(before) + 7 * len(s) + 5 * i + ord(one[0])) % len(ends)]
            other = (one, f"{one}.{two}", f"{two}{len(s)}")[i % 3]
            out += [f"{name}{at}{dot.join(host.split('.'))}", f"{other}{at}{dot.join([three, end] if i % 4 else [three, two, end])}".lower()]
        return out
    d = _digits(s)[-10:]
    if len(d) < 10:
        return []
    a, b, c = d[:3], d[3:6], d[6:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"({a}){b}-{c}"]


def look_alikes(kind: int, s: str, before: str, after: str) -> list[str]:
    """Harmless text of similar looks, made of the span's digits or of the words around it."""
    if kind == 0:
        one, two, three = _words(before, after)
        return [f"{one} (at) {two}", f"{one} @ {two}", f"{one} @ {two}. {three}", f"{one} at {two} dot {three}", f"{one} @ 5.99", f"{one} (at) {two}. {three}"]
    d = (_digits(s) * 3)[-13:]
    year, month, day = 1950 + int(d[:2]) % 90, 1 + int(d[2:4]) % 12, 1 + int(d[4:6]) % 28
    return [
        f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{year}-{year + int(d[6])}", f"{d[:3]}-{d[3:5]}-{d[5:9]}", f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}",
        f"{d[0]}.{d[1]}.{d[2:4]}.{d[4:8]}", f"{d[:2]} {d[2:5]} {d[5:8]}", d[:10], f"{d[:3]}.{d[3:6]}.{d[6:9]}", f"{year}-{month:02}-{day:02} {d[6:8]} {d[8:10]}", f"{d[:4]} {d[4:8]}",
    ]


def taught(text: str) -> list[tuple[str, tuple[int, int, int], int]]:
    """(text, candidate, label) of rewritten spans and look-alikes in the contexts of the text's e-mail and phone spans."""
    out = []
    for start, kind, end in _spread([b for b in base_spans(text) if b[1] in (0, 3)], TAUGHT):
        s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 40]
        before = before if not before or not before[-1].isalnum() else before + " "
        for i, new in enumerate(rewritten(kind, s, before, after)):
            rest = f". {after.lstrip(' .,').capitalize()}" if i % 2 else after if not after[:1].isalnum() else " " + after
            whole, at = before + new + rest, len(before)
            near = [c for c in candidates(whole) if c[1] == kind and c[0] < at + len(new) and c[2] > at]
            out += [(whole, c, REWRITTEN if c == (at, kind, at + len(new)) else NEGATIVE) for c in near]
        for new in look_alikes(kind, s, before, after):
            whole, at = before + new + (" " if after[:1].isalnum() else "") + after, len(before)
            out += [(whole, c, NEGATIVE) for c in candidates(whole) if c[1] == kind and c[0] < at + len(new) and c[2] > at]
    return out


def _spread(rows: list, most: int) -> list:
    return rows if len(rows) <= most else [rows[i * len(rows) // most] for i in range(most)]


def _learn(texts: pa.Array) -> pa.Array:
    """Descriptions of each text's labelled candidates with the label first."""
    out = []
    for t in texts.to_pylist():
        rows = [(t, c, y) for c, y in _spread(labelled(t or ""), SHOWN)] + taught(t or "")
        out.append([float(v) for whole, c, y in rows for v in (y, *describe(whole, *c))])
    return pa.array(out, pa.list_(pa.float32()))


def train(docs: DataFrame, rows: int = ROWS) -> Models:
    """Trees from the texts of the `rows` smallest hashes of doc_id; a quarter of the texts is held out."""
    few = docs.select("doc_id").distinct().where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    learn = F.arrow_udf(_learn, "array<float>")
    one = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    got = one.select("doc_id", F.xxhash64("doc_id").alias("h"), learn(F.col("text")).alias("x")).toArrow().sort_by("doc_id")
    if not len(got):
        return [None] * len(KINDS)
    width = len(describe("0", 0, 0, 1)) + 1
    x = pc.list_flatten(got["x"]).to_numpy().reshape(-1, width)
    held = np.repeat((got["h"].to_numpy() >> 8) % 4 == 0, pc.list_value_length(got["x"]).to_numpy() // width)
    return boost_kinds(x[:, 1:], x[:, 0], held)


def spans(text: str, models: Models) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: candidates that touch no other span and reach their kind's threshold are added."""
    base = base_spans(text)
    # base spans may overlap: of those that begin before a candidate's end, the largest end decides
    starts, ends = [b[0] for b in base], list(accumulate((b[2] for b in base), max))

    def touches(c: tuple[int, int, int]) -> bool:
        i = bisect_left(starts, c[2])
        return i > 0 and ends[i - 1] > c[0]

    free = [c for c in candidates(text) if models[c[1]] is not None and not touches(c)]
    if not free:
        return base, base
    x = np.array([describe(text, *c) for c in free], np.float32)
    over = np.full(len(free), -np.inf)
    for k, model in enumerate(models):
        own = x[:, 0] == k
        if model is not None and own.any():
            p = model.probability(x[own])
            over[own] = np.where(p >= model.least, p, -np.inf)
    added: list[tuple[int, int, int]] = []  # sorted; none touches another
    for i in np.argsort(-over, kind="stable"):
        if not np.isfinite(over[i]):
            break
        start, _, end = free[i]
        at = bisect_left(added, (end,))
        if not at or added[at - 1][2] <= start:
            added.insert(at, free[i])
    return base, sorted(base + added)


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in found)


def span_columns(models: Models):
    """A function of a text column: struct of base and all spans, written kind:start:end, and base counts."""

    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            base, every = spans(t or "", models)
            n = [0] * len(KINDS)
            for b in base:
                n[b[1]] += 1
            out.append({"base": _written(base), "spans": _written(every), **{f"n_{k}": v for k, v in zip(KINDS, n, strict=True)}})
        return pa.array(out, pa.struct([("base", pa.string()), ("spans", pa.string()), *[(f"n_{k}", pa.int64()) for k in KINDS]]))

    return F.arrow_udf(of, "struct<base:string,spans:string," + ",".join(f"n_{k}:bigint" for k in KINDS) + ">")


def find(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, counts of base spans by kind, base and all spans of every row."""
    x = docs.select("doc_id", span_columns(train(docs, rows))(F.col("text")).alias("x"))
    return x.select("doc_id", *[f"x.n_{k}" for k in KINDS], "x.base", "x.spans")


def redact(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets, overlapping spans by the first of them, and
    n_chars (where docs has it) counted anew; texts without spans and nulls stay."""
    models = train(docs, rows)

    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            found = spans(t, models)[1] if t else []
            parts, at = [], 0
            for start, kind, end in found:
                if start >= at:
                    parts += [t[at:start], f"[{KINDS[kind].upper()}]"]
                at = max(at, end)
            out.append("".join([*parts, t[at:]]) if found else t)
        return pa.array(out, pa.string())

    out = docs.withColumn("text", F.arrow_udf(of, "string")(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
