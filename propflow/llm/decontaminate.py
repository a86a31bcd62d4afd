"""Documents that carry benchmark text, found by the q-gram lemma and banded alignment.

A window starts at every character of a benchmark item. A window of length w within k edits of a text
shares at least w + 1 - q * (k + 1) q-grams with it along at most k neighbouring diagonals, so
q-gram matches are counted in overlapping bands of diagonals, bands below that count are dropped
without loss, and the rest are aligned within the band. Items shorter than a q-gram are looked for
as whole words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Q = 12
WINDOW = 64  # code points of normalised text
EDIT_RATE = 0.05
SHORTEST = 24  # items below this are matched without edits
BLOCK_CHARS = 1 << 20  # of the benchmark that one pass over the documents looks for
SLICE = 1 << 18  # code points looked at together
_ZERO = 1 << 20  # the number of band 0: bands lie on both sides
_GAP = 16  # zeros between texts: more than any budget bridges

_GAPS = re.compile(r"[\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> str:
    """Lower case, runs of anything but letters and digits as one blank."""
    return _GAPS.sub(" ", text.lower()).strip()


def edit_budget(length: int) -> int:
    return int(length * EDIT_RATE) if length >= SHORTEST else 0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray) -> np.ndarray:
    acc = np.zeros(max(len(codes) - Q + 1, 0), dtype=np.uint64)
    for k in range(Q):
        acc = (acc ^ codes[k : k + len(acc)]) * _MULTIPLIER
        acc ^= acc >> np.uint64(29)
    return acc


class WindowIndex:
    """The q-grams of a block of items, sorted, with a table of 22-bit heads for quick refusal.

    `parts` are (item, start, text); a part that does not start its item holds no short item.
    """

    def __init__(self, parts: list[tuple[int, int, str]]):
        lines = [(item, at, normalise(text)) for item, at, text in parts]
        self.short: dict[str, list[int]] = {}
        for item, at, line in lines:
            if line and len(line) < Q and not at:
                self.short.setdefault(line, []).append(item)
        self.short_words = sorted({line.count(" ") + 1 for line in self.short})
        self.lines = [(item, at) for item, at, line in lines if len(line) >= Q]
        codes = [_codes(line) for _, _, line in lines if len(line) >= Q]
        self.codes = np.concatenate([*codes, np.zeros(0, dtype=np.uint64)])
        self.length = np.array([len(c) for c in codes], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length
        grams = [_grams(c) for c in codes]
        gram = np.concatenate([*grams, np.zeros(0, dtype=np.uint64)])
        line = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, dtype=np.int64)])
        order = np.argsort(gram, kind="stable")
        self.gram, self.line, self.place = gram[order], line[order].astype(np.int64), place[order].astype(np.int64)
        self.head = np.zeros(1 << 22, dtype=bool)
        self.head[(self.gram >> np.uint64(42)).astype(np.int64)] = True
        self.width = np.minimum(self.length, WINDOW)
        self.budget = np.array([edit_budget(int(w)) for w in self.width], dtype=np.int64)
        self.bound = np.maximum(1, self.width + 1 - Q * (self.budget + 1))

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(line, start, distance, a place inside) of every window that the text holds within its budget."""
        grams = _grams(codes)
        spots = np.flatnonzero(self.head[(grams >> np.uint64(42)).astype(np.int64)])
        low = np.searchsorted(self.gram, grams[spots], side="left")
        high = np.searchsorted(self.gram, grams[spots], side="right")
        hits = high - low
        spots, low, hits = spots[hits > 0], low[hits > 0], hits[hits > 0]
        if not len(spots):
            return
        at = np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        line, diagonal = self.line[at], np.repeat(spots, hits) - self.place[at]
        # bands are twice the budget wide and start every budget + 1 diagonals: any k + 1
        # neighbouring diagonals lie in one of them
        band = np.floor_divide(diagonal, self.budget[line] + 1)
        # one number per (line, band, place): distinct places of a band are distinct q-grams
        cells = ((line << 22 | band + _ZERO) << 20) | self.place[at]
        cells = np.unique(np.concatenate([cells, cells - (1 << 20)]))
        place, group = cells & ((1 << 20) - 1), cells >> 20
        line = group >> 22
        # a run of `bound` cells that fits into a window gives the starts of the windows around it
        far = np.arange(len(cells)) + self.bound[line] - 1
        end = np.minimum(far, len(cells) - 1)
        reach = self.width[line] - Q
        fits = (far < len(cells)) & (group[end] == group) & (place[end] - place <= reach)
        first = np.maximum(place[end] - reach, 0)[fits]
        last = np.minimum(place, self.length[line] - self.width[line])[fits]
        group = group[fits]
        if not len(group):
            return
        # both ends rise within a group: each start is taken once
        again = group[1:] == group[:-1]
        first[1:] = np.where(again, np.maximum(first[1:], last[:-1] + 1), first[1:])
        sizes = np.maximum(last - first + 1, 0)
        for a in range(0, len(group), 1024):
            n = sizes[a : a + 1024]
            start = np.repeat(first[a : a + 1024], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(group[a : a + 1024], n)
            line, band = owner >> 22, (owner & ((1 << 22) - 1)) - _ZERO
            for width in np.unique(self.width[line]):
                own = np.flatnonzero(self.width[line] == width)
                budget = edit_budget(int(width))
                low = band[own] * (budget + 1) + start[own]
                found = banded_distances(self.codes, self.offset[line[own]] + start[own], int(width), codes, low, 2 * budget + 2)
                near = found <= budget
                yield from zip(
                    line[own][near].tolist(), start[own][near].tolist(), found[near].tolist(),
                    (np.maximum(low[near], 0) + int(width) // 2).tolist(), strict=True,
                )

    def short_matches(self, text: str) -> set[int]:
        """The items shorter than a q-gram that the text holds as whole words."""
        if not self.short:
            return set()
        words, found = normalise(text).split(" "), set()
        for n in self.short_words:
            for k in range(len(words) - n + 1):
                found.update(self.short.get(" ".join(words[k : k + n]), ()))
        return found


def banded_distances(items: np.ndarray, starts: np.ndarray, length: int, text: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """The least edits that turn each window `items[start : start + length]` into a stretch of the text.

    Both ends of a stretch are free; paths stay on `width` diagonals from text place `low` on.
    """
    place = np.arange(width)
    row = np.zeros((len(starts), width), dtype=np.int64)
    for i in range(length):
        # cell d of step i is text position low + i + d
        spot = low[:, None] + i + place
        inside = (spot >= 0) & (spot < len(text))
        same = inside & (text[np.clip(spot, 0, len(text) - 1)] == items[starts + i][:, None])
        best = row + ~same
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(best - place, axis=1) + place
    return row.min(axis=1) if len(starts) else np.zeros(0, dtype=np.int64)


def _pools(texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of texts set side by side, where each stretch starts, and whose it is.

    A text beyond a slice is cut into stretches that overlap by more than a window.
    """
    gap = np.zeros(_GAP, dtype=np.uint64)
    parts, starts, owners, size = [], [], [], 0
    for row, text in enumerate(texts):
        codes = _codes(normalise(text.as_py() or ""))
        for at in range(0, max(len(codes) - 2 * WINDOW, 1), SLICE):
            part = codes[at : at + SLICE + 2 * WINDOW]
            parts += [part, gap]
            starts.append(size)
            owners.append(row)
            size += len(part) + _GAP
            if size >= SLICE:
                yield np.concatenate(parts), np.array(starts), np.array(owners)
                parts, starts, owners, size = [], [], [], 0
    if size:
        yield np.concatenate(parts), np.array(starts), np.array(owners)


def _search(batches, index: WindowIndex):
    for batch in batches:
        best: dict[tuple[int, int, int], int] = {}
        for codes, starts, owners in _pools(batch.column("text")):
            for line, start, distance, place in index.matches(codes):
                item, at = index.lines[line]
                key = int(owners[np.searchsorted(starts, place, side="right") - 1]), item, at + start
                best[key] = min(distance, best.get(key, distance))
        if index.short:
            for row, text in enumerate(batch.column("text")):
                best.update({(row, item, 0): 0 for item in index.short_matches(text.as_py() or "")})
        keys = sorted(best)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array([row for row, _, _ in keys], pa.int64())),
                pa.array([item for _, item, _ in keys], pa.int64()),
                pa.array([start for _, _, start in keys], pa.int32()),
                pa.array([best[key] for key in keys], pa.int32()),
            ],
            ["doc_id", "item_id", "window_start", "distance"],
        )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, distance) of every document and benchmark item it holds a window of.

    The benchmark is looked for in blocks of bounded size, one pass over the documents each. Null
    and empty texts and items match nothing, items shorter than a q-gram match as whole words;
    repeated items match alike; rows of one id count together.
    """
    spark = docs.sparkSession
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = F.expr(f"explode(sequence(0, greatest(length(text) - 1, 0), {BLOCK_CHARS // 4}))")
    parts = items.select("item_id", "text", cut.alias("at")).select(
        "item_id",
        F.expr(f"substring(text, at + 1, {BLOCK_CHARS // 4 + 4 * WINDOW})").alias("text"),
        "at",
    )
    parts = parts.withColumn("block", F.pmod(F.xxhash64("item_id", "at"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = parts.where(F.col("block") == block).orderBy("item_id", "at").collect()
        index = spark.sparkContext.broadcast(WindowIndex([(r.item_id, r["at"], r.text) for r in rows]))
        part = texts.mapInArrow(
            lambda batches, index=index: _search(batches, index.value),
            "doc_id bigint, item_id bigint, window_start int, distance int",
        )
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(
        F.countDistinct("window_start").alias("n_windows"), F.min("distance").alias("distance")
    )


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of the benchmark, all columns kept; without an id they stay."""
    named = leaks(docs, benchmark).select(F.col("doc_id").alias("_leak_id")).distinct()
    return docs.join(named, F.col("doc_id").cast("long") == F.col("_leak_id"), "left_anti")
