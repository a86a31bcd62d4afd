"""Points joined with the intervals of a table that hold them."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from propflow.session import materialize

MOST_CELLS = 4096
CELL_POINTS = 8192
CELL_INTERVALS = 512
TOTALS_SHARE = 16  # a cell that is folded, not paired, may hold more

_HALF = 32
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_FOLDS = {"sum": np.add, "min": np.fmin, "max": np.maximum}


def _numbers(values: list, kind: str) -> Column:
    """A constant array in one expression, however long; folded while the plan is made, not built for each row."""
    return F.expr(f"array({', '.join(f'{kind}({str(v)!r})' for v in values)})")


def cell_of(value: Column, bounds: Column, size: int) -> Column:
    """How many of `size` sorted bounds do not pass the value, by bisection."""
    if not size:
        return F.lit(0)

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        open_span = span["low"] < span["high"]
        above = F.get(bounds, middle) <= value
        return F.struct(
            F.when(open_span & above, middle + 1).otherwise(span["low"]).alias("low"),
            F.when(open_span & ~above, middle).otherwise(span["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(size + 1))))
    whole = F.struct(F.lit(0).alias("low"), F.lit(size).alias("high"))
    return F.aggregate(steps, whole, halve)["low"]


def _cells_of(value: Column, bounds: list[float]) -> Column:
    """The same as `cell_of` for many rows, batch by batch."""
    edges = np.array(bounds)

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(), side="right").astype("int32"))

    return place(value) if bounds else F.lit(0)


def _merged(points: pa.Table, intervals: pa.Table, names: list[str]) -> pa.Table:
    """Both sides of a cell merged: the points in order, each interval a run of them."""
    points = points.take(pc.sort_indices(points, [("_x", "ascending")]))
    x = points.column("_x").to_numpy()
    first = np.searchsorted(x, intervals.column("_low").to_numpy(), side="left")
    after = np.searchsorted(x, intervals.column("_high").to_numpy(), side="right")
    size = np.maximum(after - first, 0)
    at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    left, right = points.take(pa.array(at)), intervals.take(pa.array(np.repeat(np.arange(len(size)), size)))
    return pa.table({n: (left if n in left.column_names else right).column(n) for n in names})


class _Partial(NamedTuple):
    """One number kept per value, cell or run: how it is made from rows, and how two are made one."""

    name: str
    rows: Column
    fold: str
    empty: float
    kind: str


class _Total:
    """A total `how` of a column as partials; whole numbers are summed in halves, so no part of a sum overflows."""

    def __init__(self, out: str, how: str, column: str, kind: str):
        self.out, self.how, self.kind = out, how, kind
        value, whole = F.col(column) if column != "*" else F.lit(1), kind in _WHOLE
        if how not in ("count", *_FOLDS) or not (how == "count" or whole or kind in ("float", "double")):
            raise ValueError(f"no total {how!r} of a {kind}")
        wide, number = ("bigint", value.cast("bigint")) if whole else ("double", value.cast("double"))
        self.partials = [_Partial(f"_{out}_n", F.count(value), "sum", 0, "bigint")]
        if how == "sum" and whole:
            halves = F.shiftright(number, _HALF), number.bitwiseAND((1 << _HALF) - 1)
            self.partials += [_Partial(f"_{out}_{i}", F.sum(h), "sum", 0, wide) for i, h in enumerate(halves)]
        elif how != "count":
            least, most = (np.iinfo(np.int64).min, np.iinfo(np.int64).max) if whole else (-np.inf, np.nan)
            empty = {"sum": 0, "max": least, "min": most}[how]  # NaN is the greatest number, as in Spark
            self.partials.append(_Partial(f"_{out}_0", getattr(F, how)(number), how, empty, wide))

    def whole(self) -> Column:
        """The total of partials that are folded to the end; null where no value was."""
        n, *rest = (F.col(p.name) for p in self.partials)
        if self.how == "count":
            return n.alias(self.out)
        found = rest[0] if self.how == "sum" else rest[0].cast(self.kind)
        if len(rest) == 2:
            carried = rest[0] + F.shiftright(rest[1], _HALF)
            found = carried * F.lit(1 << _HALF) + rest[1].bitwiseAND((1 << _HALF) - 1)
        return F.when(n > 0, found).alias(self.out)


def _folds(partials: list[_Partial]) -> list[Column]:
    return [getattr(F, p.fold)(p.name).alias(p.name) for p in partials]


def _folded(values: np.ndarray, first: np.ndarray, after: np.ndarray, fold: np.ufunc, empty: float) -> np.ndarray:
    """The fold of each run of the values from `first` to before `after`, out of folds of 1, 2, 4, ... neighbours."""
    found = np.full(len(first), empty, dtype=values.dtype)
    while (open_runs := first < after).any():
        odd = open_runs & (first % 2 == 1)
        found[odd] = fold(found[odd], values[first[odd]])
        odd = open_runs & (after % 2 == 1)
        found[odd] = fold(found[odd], values[after[odd] - 1])
        first, after = (first + 1) // 2, after // 2
        if len(values) % 2:
            values = np.append(values, np.array([empty], dtype=values.dtype))
        values = fold(values[0::2], values[1::2])
    return found


def _totalled(points: pa.Table, intervals: pa.Table, ends: list[str], partials: list[tuple]) -> pa.Table:
    """Per interval the fold of the points inside it, and a row for each point as large as an end of it.

    What is strictly between the ends as doubles is so beyond their precision too; a point at an end is
    looked at again by the caller, so its value comes along.
    """
    points = points.take(pc.sort_indices(points, [("_x", "ascending")]))
    x = points.column("_x").to_numpy()
    low, high = (intervals.column(c).to_numpy() for c in ("_low", "_high"))
    from_low, after_low = (np.searchsorted(x, low, side=s) for s in ("left", "right"))
    from_high, after_high = (np.searchsorted(x, high, side=s) for s in ("left", "right"))
    inside = np.flatnonzero(after_low < from_high)
    first = np.concatenate([from_low, from_high])
    size = np.concatenate([after_low - from_low, np.where(high > low, after_high - from_high, 0)])
    at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    edge = points.take(pa.array(at))
    of = np.concatenate([inside, np.repeat(np.tile(np.arange(len(low)), 2), size)])
    columns = {n: intervals.column(n).take(pa.array(of)) for n in ("_id", *ends)}
    none = pa.nulls(len(inside), points.schema.field("_value").type)
    columns["_value"] = pa.chunked_array([none, *edge.column("_value").chunks])
    for name, fold, empty, kind in partials:
        kept = pc.fill_null(points.column(name), pa.scalar(empty, points.schema.field(name).type)).to_numpy()
        runs = _folded(kept, after_low[inside], from_high[inside], _FOLDS[fold], empty)
        own = np.concatenate([runs, kept[at]])
        columns[name] = pa.array(own, pa.int64() if kind == "bigint" else pa.float64())
    return pa.table(columns)


def _nodes(first: Column, after: Column, levels: int) -> Column:
    """The range of cells from `first` to before `after` as few nodes of a binary tree over the cells."""
    found = []
    for k in range(levels):
        low, high = F.shiftright(first + (1 << k) - 1, k), F.shiftright(after, k)
        found.append(F.when((low < high) & (low % 2 == 1), _node(low, k)))
        found.append(F.when((low < high) & (high % 2 == 1), _node(high - 1, k)))
    return F.filter(F.array(*found), lambda node: node.isNotNull())


def _node(cell: Column, level: int) -> Column:
    return cell.cast("bigint") + (level << _HALF)


def range_join(
    points: DataFrame,
    value: str,
    intervals: DataFrame,
    low: str,
    high: str,
    cells: int | None = None,
    cell_points: int = CELL_POINTS,
    cell_intervals: int = CELL_INTERVALS,
    totals: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Every point with every interval that holds its value, ends included; all columns of both.

    The number line is cut into cells at quantiles of the points. A point lies in one cell, an
    interval goes to all cells it meets. Where a cell holds more points or intervals than one task
    should, both are dealt to shares and every pair of shares meets, so equal values or wide intervals
    do not gather in a task. A task sorts its points and cuts each interval's run out of them.

    Null and NaN values and null ends hold nothing, nor does an interval whose low end is the higher.
    The two tables' column names must differ.

    With `totals`, {name: (count, sum, min or max; column, `*` to count rows)}, the pairs are not
    written out: a row for each interval that holds a point, its columns and the totals over its
    points. Points of equal value are one first, an interval goes to the cells of its ends only, and the
    cells between come from a binary tree over the cells, so the work grows with the rows, not the pairs.
    """
    if shared := set(points.columns) & set(intervals.columns):
        raise ValueError(f"columns {sorted(shared)} on both sides")
    x = F.col(value).cast("double")
    left = points.where(x.isNotNull() & ~F.isnan(x))
    kinds_of = {f.name: f.dataType.simpleString() for f in points.schema} | {"*": "int"}
    wanted = [_Total(out, how, column, kinds_of[column]) for out, (how, column) in (totals or {}).items()]
    partials = [p for t in wanted for p in t.partials]
    if totals is not None:
        left = left.groupBy(F.col(value).alias("_value")).agg(*(p.rows.alias(p.name) for p in partials))
        value, x = "_value", F.col("_value").cast("double")
    left = left.withColumns({"_x": x, "_id": F.monotonically_increasing_id()})
    ends = {"_low": F.col(low).cast("double"), "_high": F.col(high).cast("double"), "_id": F.monotonically_increasing_id()}
    right = intervals.where((F.col(low) <= F.col(high)) & ~F.isnan(F.col(low).cast("double"))).withColumns(ends)
    left, right = materialize(left), materialize(right)  # ids must not change when a task is run again
    cells = cells or min(MOST_CELLS, max(1, left.count() // cell_points))
    bounds: list[float] = []
    if cells > 1:
        shares = _numbers([i / cells for i in range(1, cells)], "double")
        found = left.agg(F.percentile_approx("_x", shares, F.lit(10 * cells)).alias("b")).first().b
        bounds = sorted(set(found or []))
    edges = _numbers(bounds, "double")

    def cell(column: str) -> Column:
        return cell_of(F.col(column), edges, len(bounds))

    left = left.withColumn("_cell", _cells_of(F.col("_x"), bounds))
    right = right.withColumns({"_first": cell("_low"), "_last": cell("_high")})
    if bounds:
        left, right = materialize(left), materialize(right)  # the cells are looked up once
    all_right, met_cells = right, F.sequence("_first", "_last")
    if totals is not None:
        met_cells = F.array_distinct(F.array("_first", "_last"))
        cell_points, cell_intervals = cell_points * TOTALS_SHARE, cell_intervals * TOTALS_SHARE
        levels = (len(bounds) + 1).bit_length()
        per_cell = left.groupBy("_cell").agg(*_folds(partials))  # a row per cell
        in_tree = F.explode(F.array(*(_node(F.shiftright("_cell", k), k) for k in range(levels)))).alias("_node")
        tree = materialize(per_cell.select(in_tree, *(p.name for p in partials)).groupBy("_node").agg(*_folds(partials)))
        between = right.select("_id", F.explode(_nodes(F.col("_first") + 1, F.col("_last"), levels)).alias("_node"))
        between = between.join(tree, "_node").select("_id", *(p.name for p in partials))
    right = right.withColumn("_cell", F.explode(met_cells))
    counts = left.groupBy("_cell").agg(F.count(F.lit(1)).alias("p"))
    counts = counts.join(right.groupBy("_cell").agg(F.count(F.lit(1)).alias("i")), "_cell").collect()  # a row per cell at most
    parts = [[1] * (len(bounds) + 1) for _ in range(2)]
    for r in counts:
        parts[0][r._cell], parts[1][r._cell] = -(-r.p // cell_points), -(-r.i // cell_intervals)
    of_points, of_intervals = (F.get(_numbers(p, "bigint"), F.col("_cell")) for p in parts)
    zero = F.lit(0).cast("long")
    left = left.withColumns({"_p": F.pmod("_id", of_points), "_i": F.explode(F.sequence(zero, of_intervals - 1))})
    right = right.withColumns({"_i": F.pmod("_id", of_intervals), "_p": F.explode(F.sequence(zero, of_points - 1))})
    keys, names = ["_cell", "_p", "_i"], [*points.columns, *intervals.columns]
    both = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    if totals is None:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*points.schema, *intervals.schema])
        met = both.applyInArrow(lambda a, b: _merged(a, b, names), kinds)
        return met.where(F.col(value).between(F.col(low), F.col(high)))  # beyond the precision of a double
    ends_of = list(dict.fromkeys([low, high]))
    fields = [("_id", "bigint"), *((c, intervals.schema[c].dataType.simpleString()) for c in ends_of)]
    fields += [("_value", left.schema["_value"].dataType.simpleString()), *((p.name, p.kind) for p in partials)]
    plain = [(p.name, p.fold, p.empty, p.kind) for p in partials]  # no Column goes to a task
    met = both.applyInArrow(lambda a, b: _totalled(a, b, ends_of, plain), ", ".join(f"`{n}` {k}" for n, k in fields))
    met = met.where(F.col("_value").isNull() | F.col("_value").between(F.col(low), F.col(high)))
    found = met.select("_id", *(p.name for p in partials)).unionByName(between).groupBy("_id").agg(*_folds(partials))
    return all_right.join(found, "_id").select(*intervals.columns, *(t.whole() for t in wanted))
