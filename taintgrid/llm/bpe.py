"""Byte-level BPE encoding and decoding.

Texts are cut into words by the tokenizer's pattern. Different words are counted over all texts; the frequent
ones, at most `known`, are encoded once by Spark's higher-order functions, which fold the ranked merges over
the word's byte pieces with the rank map as a literal, and go to the executors as one bounded table of word
hash and ids. Any other word is encoded in its own row by the same fold. Words over LONG bytes, where the fold
would copy long arrays for each merge, are merged with a heap. Decoding concatenates the ids' byte pieces.

Defined cases: a null or empty text has no ids; repeated rows get equal results; text that looks like a special
token is ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintgrid.llm import words as W
from taintgrid.session import checkpoint

PATTERN = public_tokenizers.PATTERN
RANKS = "byte_bpe_multi_50k.tiktoken"
KNOWN = 1 << 22  # words in the table that is sent to executors, 12 bytes each and 2 for each id
LONG = 256
BUCKETS = 1 << 13  # a power of two
NONE = (1 << 31) - 1
SLICE = 1 << 20  # bytes of text that a Python task holds as objects at a time; one text at least


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: maps of hexadecimal piece to rank, one for each hash bucket, so that a lookup is short."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.hex()
        buckets[xxhash.xxh64_intdigest(name, 42) % BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(word: Column, table: Column) -> Column:
    """Ids of a word: while some neighbours join to a piece of the map, the leftmost pair of the lowest rank joins.

    table: a bound variable of rank_literal, so that the plan holds the map once.
    """

    def rank(x: Column) -> Column:
        return F.coalesce(F.try_element_at(F.get(table, F.xxhash64(x).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), x), F.lit(NONE))

    def start(pieces: Column) -> Column:
        pairs = F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda a, b: rank(F.concat(a, F.coalesce(b, F.lit("-")))))
        return F.struct(pieces.alias("p"), pairs.alias("r"))

    # a bound value is copied with all it holds, so only the place is bound and the joined piece is put together where needed
    def join(s: Column, i: Column) -> Column:
        p, r = s["p"], s["r"]
        n = F.size(p)
        x = F.concat(F.get(p, i - 1), F.get(p, i))
        right = F.concat(x, F.coalesce(F.get(p, i + 1), F.lit("-")))
        fresh = F.when(i > 1, F.array(F.concat(F.get(p, i - 2), x), right)).otherwise(F.array(right))
        return F.struct(
            F.concat(F.slice(p, F.lit(1), i - 1), F.array(x), F.slice(p, i + 2, n)).alias("p"),
            F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), F.transform(fresh, rank), F.slice(r, i + 2, n)).alias("r"))

    def merge(s: Column, _: Column) -> Column:
        low = F.array_min(s["r"])
        return F.when(low == NONE, s).otherwise(let(F.array_position(s["r"], low).cast("int"), lambda i: join(s, i)))

    size = F.octet_length(word)
    pieces = let(F.lower(F.hex(word)), lambda h: F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), lambda i: F.substring(h, 2 * i + 1, F.lit(2))))
    return let(pieces, lambda p: F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), start(p), merge, lambda s: F.transform(s["p"], rank)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word: a heap of joinable pairs by rank and place, and links to the neighbours left."""
    n = len(word)
    piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = piece[i]
        j = after[i]
        if left is None or j >= n or len(left) + len(piece[j]) != size:
            continue  # one of the two has joined another since
        piece[i], piece[j] = left + piece[j], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i] + piece[k])) is not None:
                heapq.heappush(heap, (r, i, len(piece[i]) + len(piece[k])))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h] + piece[i])) is not None:
            heapq.heappush(heap, (r, h, len(piece[h]) + len(piece[i])))
    return [ranks[p] for p in piece if p is not None]


LETTER, NUMBER, SPACE, OTHER = range(4)
_tables: dict[str, np.ndarray] = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point its class by the pattern's own rules, and a random number."""
    if not _tables:
        kind = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for name, rule in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(rule, every):
                kind[ord(m.group()[0]) : ord(m.group()[-1]) + 1] = name
        kind[0xD800:0xE000] = OTHER
        _tables["kind"], _tables["value"] = kind, W.mix(np.arange(1, 0x110001, dtype=np.uint64))
    return _tables["kind"], _tables["value"]


def cut(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts of the words that public_tokenizers.PATTERN finds in texts laid end to end; begins: start of each non-empty text.

    Runs of letters, numbers, white space and other characters are words, but for three rules of the pattern: a blank
    right before another run belongs to it; of white space before another run the last character stands alone (or is that blank);
    and an apostrophe that begins a word takes a following s, t, m, d, re, ve or ll.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[0][points]
    first = np.zeros(n + 1, bool)
    first[begins] = first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    more = ~first[1:]  # a next character of the same text
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & more[:-1])
    start[last] = True
    blank = last[points[last] == 32]
    start[blank + 1] = False
    single = np.flatnonzero((points == 39) & start[:n] & more)
    single = single[kind[single + 1] == LETTER]
    if len(single):
        a = points[single + 1]
        b = np.where(single + 2 < n, points[np.minimum(single + 2, n - 1)], 0)
        b[first[np.minimum(single + 2, n)]] = 0
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for rows, size in ((single[one], 1), (single[two & ~one], 2)):
            start[rows + 1] = False
            rest = rows + 1 + size
            rest = rest[rest < n]
            start[rest[(kind[rest] == LETTER) & ~first[rest]]] = True
    return np.flatnonzero(start[:n])


class Slice:
    """Some texts of a column cut into words: key (64-bit hash), text and first and last code point of each word."""

    def __init__(self, texts: list[str], pattern: str):
        self.text = "".join(texts)
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        length = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(length) - length
        if pattern == PATTERN:
            self.start = cut(points, begins[length > 0])
        else:
            find = regex.compile(pattern).finditer
            self.start = np.array([b + m.start() for t, b in zip(texts, begins, strict=True) for m in find(t)], np.int64)
        self.end = np.append(self.start[1:], len(points)) if len(self.start) else self.start
        self.key = W.hashes(points, self.start, self.end, _classes()[1]).view(np.int64)
        self.counts = np.bincount(np.searchsorted(begins + length, self.start, "right"), minlength=len(texts))

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]


def _slices(texts: pa.Array, pattern: str) -> Iterator[tuple[int, int, Slice]]:
    _, offsets = W.text_bytes(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        yield first, last, Slice([t or "" for t in texts.slice(first, last - first).to_pylist()], pattern)
        first = last


class Known:
    """Ids of frequent words by the words' hashes, in flat arrays."""

    def __init__(self, rows: pa.Table):
        key = rows["key"].to_numpy()
        order = np.argsort(key)
        ids = rows["ids"].combine_chunks().take(pa.array(order))
        self.key = key[order]
        self.start = ids.offsets.to_numpy().astype(np.uint32)
        self.ids = ids.flatten().to_numpy()
        if not len(self.ids) or self.ids.max() < 1 << 16:
            self.ids = self.ids.astype(np.uint16)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is not known."""
        if not len(self.key) or not len(key):
            return np.full(len(key), -1)
        at = np.searchsorted(self.key, key).clip(max=len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


def is_long(word: str) -> bool:
    return len(word) > LONG // 4 and len(word.encode()) > LONG


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """key, word, n of the words of at most LONG bytes in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, s in _slices(batch.column(0), pattern):
                key, first, n = np.unique(s.key, return_index=True, return_counts=True)
                words = [s.word(i) for i in first]
                short = np.array([not is_long(w) for w in words], bool)
                yield pa.RecordBatch.from_arrays([pa.array(key[short]), pa.array([w for w, k in zip(words, short, strict=True) if k], pa.string()), pa.array(n[short])], ["key", "word", "n"])

    return docs.select("text").mapInArrow(count, "key bigint, word string, n bigint").groupBy("key", "word").agg(F.sum("n").alias("n"))


def known_words(counts: DataFrame, table: Column, known: int) -> tuple[Known, bool]:
    """Ids of the words frequent enough that at most `known` words are as frequent, folded by Spark; whether these are all."""
    level = F.floor(F.log2("n") * 4).cast("int")
    by_level = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)  # some hundred rows
    least, total = 0, 0
    for at, n in by_level:
        total += n
        if total > known:
            least = at + 1
            break
    rows = counts.where(level >= least).select("key", let(table, lambda t: fold(F.col("word"), t)).alias("ids")).toArrow()
    return Known(rows), least == 0


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = PATTERN, known: int = KNOWN) -> DataFrame:
    """doc_id, ids (an array of int) and the bytes they decode to, of every row. Word statistics are taken from docs."""
    ranks = read_ranks(path or public_tokenizers.path(RANKS))
    table = rank_literal(ranks)
    words, complete = known_words(checkpoint(word_counts(docs, pattern)), table, known)
    sent = docs.sparkSession.sparkContext.broadcast((words, ranks, Pieces(ranks)))

    def rare(texts: pa.Array) -> pa.Array:
        out: list[list[str]] = []
        for first_row, last_row, s in _slices(texts, pattern):
            key, first = np.unique(s.key, return_index=True)
            row = sent.value[0].find(key)
            words = {int(k): w for k, i in zip(key[row < 0], first[row < 0], strict=True) if not is_long(w := s.word(i))}
            strange = np.flatnonzero(np.isin(s.key, key[row < 0]))
            owner = np.repeat(np.arange(last_row - first_row), s.counts)[strange]
            bounds = np.searchsorted(owner, np.arange(last_row - first_row + 1))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                out.append([words[k] for k in dict.fromkeys(s.key[strange[lo:hi]].tolist()) if k in words])
        return pa.array(out, pa.list_(pa.string()))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ranks, pieces = sent.value
        for batch in batches:
            names, texts = batch.columns[:2]
            for first_row, last_row, s in _slices(texts, pattern):
                key, first = np.unique(s.key, return_index=True)
                row = table.find(key)
                part = slice(first_row, last_row)
                own: dict[str, list[int]] = {}
                if not complete:
                    for found, of in zip(batch.column("words")[part].to_pylist(), batch.column("ids")[part].to_pylist(), strict=True):
                        own.update(zip(found, of, strict=True))
                missing = np.flatnonzero(row < 0)
                lists = [np.array(own[w] if (w := s.word(i)) in own else merge_long(w.encode(), ranks), np.int32) for i in first[missing]]
                here = np.array([len(x) for x in lists], np.int64)
                # where each different word's ids begin, the slice's own lists after the table's, and how many they are
                begin, size = table.start[row].astype(np.int64), (table.start[row + 1] - table.start[row]).astype(np.int64)
                begin[missing], size[missing] = len(table.ids) + np.cumsum(here) - here, here
                place = np.searchsorted(key, s.key)
                n = size[place]
                take = np.repeat(begin[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                low = take < len(table.ids)
                ids = np.empty(len(take), np.int32)
                ids[low], ids[~low] = table.ids[take[low]], np.concatenate([np.zeros(0, np.int32), *lists])[take[~low] - len(table.ids)]
                ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(s.counts)])].astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([names[part], out, pieces.decode(out)], ["doc_id", "ids", "decoded"])

    rows = docs.select("doc_id", "text")
    if not complete:
        rows = rows.withColumn("words", F.arrow_udf(rare, "array<string>")(F.col("text")))
        rows = rows.withColumn("ids", let(table, lambda t: F.transform("words", lambda w: fold(w, t))))
    return rows.mapInArrow(assemble, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


class Pieces:
    """The ranks' byte pieces laid end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
        for piece, i in ranks.items():
            self.size[i] = len(piece)
        self.at = np.cumsum(self.size.clip(0)) - self.size.clip(0)
        self.flat = np.frombuffer(b"".join(p for p, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def decode(self, lists: pa.Array) -> pa.Array:
        """The pieces of each list of ids in a row. Null gives null; an id outside the ranks is an error."""
        out = []
        for x in lists:
            if not x.is_valid:
                out.append(None)
                continue
            own = np.asarray(x.values, np.int64)
            if len(own) and (own.min() < 0 or own.max() >= len(self.size) or self.size[own].min() < 0):
                raise ValueError("an id without a piece")
            n = self.size[own]
            out.append(self.flat[np.repeat(self.at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
        return pa.array(out, pa.binary())


def encode(docs: DataFrame, path: str | None = None, **settings) -> DataFrame:
    """doc_id and ids of every row."""
    return round_trip(docs, path, **settings).select("doc_id", "ids")


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes of a column of arrays of ids. Null gives null; an id outside the ranks is an error."""
    pieces = Pieces(read_ranks(path or public_tokenizers.path(RANKS)))
    return F.arrow_udf(lambda lists: pieces.decode(lists), "binary")(ids)
