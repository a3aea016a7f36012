"""Vectorised views of Arrow text columns: bytes, words, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
U64 = np.uint64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between calls up to a million."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    up, down = _POWERS["up"], _POWERS["down"]
    if len(up) > 1 << 20:
        _POWERS.clear()
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finaliser); works on a copy."""
    h = h ^ (h >> U64(31))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums s of values[i] * BASE**i, s[0] = 0."""
    up, _ = powers(len(values) + 1)
    s = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * up[: len(values)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], from ``prefix(values)``; depends on content and length only."""
    _, down = powers(len(s))
    return mix((s[end] - s[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] of all pieces, eight bytes a step, each step through the mixer: no polynomial, so that
    pieces that a polynomial in powers of an odd number can't tell apart (Thue-Morse words) are told apart."""
    lengths = ends - starts
    h = mix(lengths.astype(U64) * U64(INVERSE))
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(9, np.uint8)]), strides=(1,))
    left, done = np.arange(len(starts)), 0
    while len(left):
        rest = np.minimum(lengths[left] - done, 8)
        block = eight[starts[left] + done]
        block &= np.where(rest < 8, (U64(1) << (U64(8) * np.maximum(rest, 0).astype(U64) % U64(64))) - U64(1), ~U64(0))
        h[left] = mix((h[left] ^ block) * U64(BASE) + U64(done))
        done += 8
        left = left[lengths[left] > done]
    return h


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values."""
    s = prefix(values)
    count = max(0, len(values) - n + 1)
    _, down = powers(len(s))
    return mix((s[n : n + count] - s[:count]) * down[:count])


def leftmost_min(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every ``width`` consecutive values the least and its leftmost place."""
    v, q, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        a, b = v[:-step], v[step:]
        less = b < a
        v, q, have = np.where(less, b, a), np.where(less, q[step:], q[:-step]), have + step
    return v, q


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (a longer row stands alone)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes where ``is_word`` holds, within one row), and per row the first word's index (n + 1)."""
    flag = is_word[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins = flag.copy()
    begins[1:] &= ~flag[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = flag[edges]
    ends = flag.copy()
    ends[:-1] &= ~flag[1:]
    cut = edges[edges > 0] - 1
    ends[cut] = flag[cut]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def same_pieces(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether data[a:a+length] equals data[b:b+length], for each of the pieces."""
    equal = np.ones(len(lengths), bool)
    total = np.cumsum(lengths)
    at = 0
    while at < len(lengths):  # two megabytes at a time
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 21), "right")))
        size = lengths[at:end]
        some = np.flatnonzero(size > 0)
        if len(some):
            differ = gather(data, a[at:end], size) != gather(data, b[at:end], size)
            begin = (np.cumsum(size) - size)[some]
            equal[at + some] = np.add.reduceat(differ, begin, dtype=np.int64) == 0
        at = end
    return equal


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """data[start:start+length] of all pieces, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, data.dtype)
    before = np.cumsum(lengths) - lengths
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts - before, lengths)
    return data[index]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pieces with a space after each, and where each begins: equal sequences of pieces are equal bytes."""
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[at + lengths] = False
    out[keep] = gather(data, starts, lengths)
    return out, at


def table_of(include) -> np.ndarray:
    """A table of 256 flags from a rule on the byte."""
    return np.array([bool(include(b)) for b in range(256)])


#: Words of the benchmark contract on lower-cased bytes: digits, a-z and all beyond ASCII.
ALNUM = table_of(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words between white space (space, tab to carriage return).
NOT_SPACE = table_of(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
