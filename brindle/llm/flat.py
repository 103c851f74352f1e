"""Words of whole Arrow batches by numpy: one array of bytes, and places in it; no Python object a word, no cache a worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What ends a word of the contracts: \x20 and \x09 to \x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_random = np.random.default_rng(20)
#: A random number for each byte; a word's name is the sum of its bytes' numbers, each times a power of ODD[0].
NUMBER = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
#: Bytes of texts that are taken at once.
SLICE = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(ODD[4])
    return x ^ (x >> np.uint64(29))


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges (a, b) of a batch whose texts have about ``size`` bytes, and one row at least."""
    _, at = buffer(column)
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield a, b
        a = b


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each row begins in them, with their end; a null has none."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of True begin and end, none of them past its row's end; and how many begin before each row."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, at)


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first): the words' places, and the number of each row's first word, with their count at the end."""
    return runs(~IS_SPACE[buf], at)


def names(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name for each run of bytes (begin, end), of at least one byte each: equal runs have equal names."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    at = np.arange(int(first[-1] + size[-1]), dtype=np.int64)
    within = at - np.repeat(first, size)
    power = np.full(int(size.max()), ODD[0], np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    at += np.repeat(begin - first, size)
    value = NUMBER.take(buf.take(at))
    value *= power.take(within)
    return mixed(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(ODD[1]))


def sorted_sets(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct names of each row, one after the other, and where each row begins, with their end."""
    names = names.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        names[a:b].sort()
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    inside = first[:-1][np.diff(first) > 0]
    new[inside] = True
    return names[new], np.concatenate([[0], np.cumsum(new)])[first]


def shingles(buf: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names of each row's n-grams of lower-cased words, and where each row begins, with their end. A row of
    fewer words has one: all of them."""
    low = LOWER[buf]
    begin, end, first = words(low, at)
    h = names(low, begin, end)
    count = np.diff(first)
    each = np.maximum(count - n + 1, np.minimum(count, 1))
    out_first = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(int(out_first[-1]), np.uint64)
    row = np.repeat(np.arange(len(count)), count)
    if len(h) >= n:
        total = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            total = mixed(total * np.uint64(ODD[i % 4]) + h[i : len(h) - n + 1 + i])
        whole = row[: len(h) - n + 1] == row[n - 1 :]
        full = np.repeat(count >= n, each)
        out[full] = total[whole]
    for k in range(1, n):
        rows = np.flatnonzero(count == k)
        total = np.full(len(rows), k, np.uint64)
        for i in range(k):
            total = mixed(total * np.uint64(ODD[i % 4]) + h[first[rows] + i])
        out[out_first[rows]] = total
    return sorted_sets(out, out_first)
