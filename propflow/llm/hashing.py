"""Vectorised word and n-gram hashes over the bytes of Arrow text columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
WORDS_PER_SHINGLE = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs get unrelated outputs, different inputs stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of table[byte] * base ** place, wrapping at 64 bits; one longer than `data`."""
    up, _ = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that depend on their content alone."""
    _, down = _powers_to(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows; nulls are empty, runs hold some MB or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, at + 1), len(column))
        yield at, offsets[at : stop + 1] - offsets[at], data[offsets[at] : offsets[stop]]
        at = stop


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each run of non-blank bytes; words never cross rows."""
    solid = ~_BLANK[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash), sorted and distinct: five-word shingles, a shorter text as one shingle."""
    low = _LOWER[data]
    row, starts, ends = word_spans(offsets, low)
    words = span_hashes(prefix_sums(low), starts, ends)
    size = WORDS_PER_SHINGLE
    rows, hashes = [], []
    if len(words) >= size:
        n = len(words) - size + 1
        acc = words[:n]
        for k in range(1, size):
            acc = mix(acc * _BASE + words[k : k + n])
        whole = row[:n] == row[size - 1 :]
        rows.append(row[:n][whole])
        hashes.append(acc[whole])
    counts = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    for length in range(1, size):
        short = np.flatnonzero(counts == length)
        if len(short):
            acc = mix(words[first[short]] + np.uint64(length))
            for k in range(1, length):
                acc = mix(acc * _BASE + words[first[short] + k])
            rows.append(short)
            hashes.append(acc)
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    row, hashed = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
    return row[new], hashed[new]


def lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """One Arrow list of 64-bit numbers per row from values sorted by row."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))
