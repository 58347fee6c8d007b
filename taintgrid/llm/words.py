"""Words and word shingles of whole texts as 64-bit hashes, an Arrow column at a time.

A word is a run of bytes without space, tab, line feed, vertical tab, form feed or carriage return;
A-Z are lower-cased and no other letter. Null and empty texts have no words. Work arrays are bounded
by SEGMENT bytes of text at a time (a longer single word is taken whole), so a long text costs its words only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_random = np.random.default_rng(20_011)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = _random.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, step in (("up", _STEP), ("down", _BACK)):
            out = np.full(n, step, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(texts: pa.Array, most: int = SEGMENT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes, one row at least."""
    data, offsets = text_bytes(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each row."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~SEPARATOR[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, np.bincount(row, minlength=rows)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each span that depends on its own elements alone; values: a random number for each element."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
        part = data[base : ends[j - 1]]
        up, down = _power(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up, out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out + np.uint64(1))


def grams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each row, and how many each row has.

    A row of fewer than n words, one at least, has the one run of all its words.
    """
    if n > len(_GRAM):
        raise ValueError(f"at most {len(_GRAM)} words a run")
    length = np.where(counts > 0, np.maximum(counts, n), 0)
    if (length != counts).any():
        begin, put = np.cumsum(counts) - counts, np.cumsum(length) - length
        padded = np.zeros(int(length.sum()), np.uint64)
        padded[np.arange(len(words)) + np.repeat(put - begin, counts)] = words
        words = padded
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    size = len(words) - n + 1
    run = words[:size] * _GRAM[0]
    for k in range(1, n):
        run += words[k : k + size] * _GRAM[k]
    own = np.where(length > 0, length - n + 1, 0)
    whole = np.ones(size + n - 1, np.int8)
    tails = np.cumsum(length)[length > 0]
    for k in range(1, n):
        whole[tails - k] = 0
    return mix(run[whole[:size] == 1]), own
