"""Total orders without a single-task sort: ranks, ordinals and order statistics."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from propflow.session import materialize

_LOCAL_BITS = 33


def _placed(sorted_rows: DataFrame) -> DataFrame:
    """Adds partition `_part` and place `_place` of each row as it lies."""
    return (
        sorted_rows.withColumn("_at", F.monotonically_increasing_id())
        .withColumns(
            {
                "_part": F.shiftright("_at", _LOCAL_BITS).cast("int"),
                "_place": F.col("_at").bitwiseAND((1 << _LOCAL_BITS) - 1),
            }
        )
        .drop("_at")
    )


def range_sorted(df: DataFrame, *order: str) -> DataFrame:
    """Rows in range partitions, each sorted, with partition `_part` and place `_place`.

    Range bounds come from a sample, so the rows are written down once: all later
    reads see the same partitions, also after an executor is lost.
    """
    return materialize(_placed(df.repartitionByRange(*order).sortWithinPartitions(*order)))


def _running_total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the count column `_c` by its running total `_to`, batch after batch."""
    total = 0
    for batch in batches:
        upto = pc.cumulative_sum(batch.column("_c"), start=total)
        if len(upto):
            total = upto[-1].as_py()
        yield pa.RecordBatch.from_arrays([batch.column("_x"), batch.column("_c"), upto], ["_x", "_c", "_to"])


def global_rank(df: DataFrame, *order: str, out: str = "rank", first: int = 1) -> DataFrame:
    """Adds the position of each row in the total order of `order`.

    Partition sizes (one row per partition) turn local places into global ones.
    """
    tagged = range_sorted(df, *order)
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    # one row per partition: bounded by the partition count, not by the data
    ranked = tagged.join(F.broadcast(offsets), "_part")
    position = F.col("_before") + F.col("_place") + first
    return ranked.withColumn(out, position).drop("_part", "_place", "_before")


def rank_in_group(df: DataFrame, group: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Adds the 0-based position of each row within its group.

    A hot group spreads over many range partitions; only its row count per
    partition meets in one place.
    """
    tagged = range_sorted(df, *group, *order)
    pieces = tagged.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_head")
    )
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    keys = ["_part", *group]
    offsets = materialize(
        pieces.select(
            *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)),
            (F.col("_before") - F.col("_head")).alias("_shift"),
        )
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    position = (F.col("_place") + F.col("_shift")).alias(out)
    return tagged.join(offsets, same).select(*df.columns, position)


class Cell(NamedTuple):
    """A value and the ranks `first` to `end - 1` of the rows that hold it."""

    value: float
    first: int
    end: int


class OrderStatistics:
    """Exact order statistics of a numeric column, nulls and NaN skipped.

    Equal values are counted before the shuffle, so a value that fills a third of
    the rows is one row here. Only partition totals and the asked-for values
    reach the driver.
    """

    def __init__(self, df: DataFrame, value: str):
        counts = (
            df.select(F.col(value).cast("double").alias("_x"))
            .where("_x is not null and not isnan(_x)")
            .groupBy("_x")
            .agg(F.count(F.lit(1)).alias("_c"))
        )
        ordered = counts.repartitionByRange("_x").sortWithinPartitions("_x")
        totalled = ordered.mapInArrow(_running_total, "_x double, _c bigint, _to bigint")
        self._rows = materialize(_placed(totalled).select("_x", "_c", "_to", "_part"))
        totals = self._rows.groupBy("_part").agg(F.max("_to").alias("_n")).collect()
        totals.sort(key=lambda row: row._part)
        self._parts = [row._part for row in totals]
        self._ends = list(accumulate(row._n for row in totals))
        self.n = self._ends[-1] if totals else 0

    def _cells(self, ranks: Iterable[int]) -> dict[int, Cell]:
        """The value at each rank with the ranks its equals span; row groups elsewhere are skipped."""
        wanted = sorted(set(ranks))
        if not wanted:
            return {}
        if wanted[0] < 0 or wanted[-1] >= self.n:
            raise ValueError(f"ranks {wanted} outside 0..{self.n - 1}")
        starts = [0, *self._ends]
        homes = {rank: bisect_right(self._ends, rank) for rank in wanted}
        places = [(self._parts[home], rank - starts[home]) for rank, home in homes.items()]
        hit = " OR ".join(f"(_part = {part} AND _to > {at} AND _to - _c <= {at})" for part, at in places)
        offset = dict(zip(self._parts, starts, strict=False))
        found = [
            Cell(row._x, offset[row._part] + row._to - row._c, offset[row._part] + row._to)
            for row in self._rows.where(hit).collect()
        ]
        return {rank: next(c for c in found if c.first <= rank < c.end) for rank in wanted}

    def at(self, ranks: Iterable[int]) -> dict[int, float]:
        """The values at the given 0-based ranks."""
        return {rank: cell.value for rank, cell in self._cells(ranks).items()}

    def _edges(self, points: list[float]) -> list[tuple[float, int, int]]:
        """Each quantile with the number of rows below it and up to it."""
        if not self.n:
            return []
        spots = [point * (self.n - 1) for point in points]
        cells = self._cells(i for spot in spots for i in (int(spot), min(int(spot) + 1, self.n - 1)))
        edges = []
        for spot in spots:
            low, high = cells[int(spot)], cells[min(int(spot) + 1, self.n - 1)]
            edge = low.value + (high.value - low.value) * (spot - int(spot))
            cell = next((c for c in (low, high) if c.value == edge), Cell(edge, low.end, low.end))
            edges.append((edge, cell.first, cell.end))
        return edges

    def quantiles(self, points: list[float]) -> list[float]:
        """Linearly interpolated quantiles."""
        return [edge for edge, _, _ in self._edges(points)]

    def intervals(self, points: list[float]) -> tuple[list[float], list[float | None]]:
        """The quantiles and the median of each closed interval between neighbours."""
        edges = self._edges(points)
        spans = [(low[1], high[2]) for low, high in zip(edges, edges[1:], strict=False)]
        middles = [((a + b - 1) // 2, (a + b) // 2) if b > a else None for a, b in spans]
        values = self.at(rank for pair in middles if pair for rank in pair)
        medians = [(values[m[0]] + values[m[1]]) / 2 if m else None for m in middles]
        return [edge for edge, _, _ in edges], medians


def nth_smallest_hash(df: DataFrame, hashed: str, count: int, digits: int = 4) -> str | None:
    """The `count`-th smallest hex hash, found digit group by digit group.

    Each round counts the rows under the known prefix by their next digits: at most
    16 ** digits counts reach the driver, however many rows there are.
    """
    if count <= 0:
        return None
    prefix, skip = "", count
    while True:
        inside = df.where(F.col(hashed).startswith(prefix)) if prefix else df
        head = F.substring(hashed, 1, len(prefix) + digits).alias("head")
        heads = inside.groupBy(head).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(heads, key=lambda r: r.head):
            if skip <= row.n:
                break
            skip -= row.n
        else:
            raise ValueError("fewer rows than asked for")
        if row.head == prefix or row.n == 1 or len(row.head) < len(prefix) + digits:
            return inside.where(F.col(hashed).startswith(row.head)).agg(F.min(hashed)).first()[0]
        prefix = row.head
