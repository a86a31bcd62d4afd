"""Exemplar rows: the extremes and two rows next to the median of each quantile interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propflow.fixed_values import DECILES
from propflow.operators.ordering import OrderStatistics


def quantile_edges(
    df: DataFrame, value: str, points: list[float] = DECILES, accuracy: int | None = None
) -> list[float]:
    """Interval edges; `accuracy` trades exactness for a single sketch pass."""
    if accuracy:
        sketch = F.percentile_approx(F.col(value).cast("double"), points, accuracy)
        return list(df.agg(sketch).first()[0] or [])
    return OrderStatistics(df, value).quantiles(points)


def interval_of(value: str, edges: list[float]) -> Column:
    """The 0-based intervals that hold the column's value, ends included, null for the others."""
    ends = [f"CAST('{edge!r}' AS DOUBLE)" for edge in edges]
    spans = enumerate(zip(ends, ends[1:], strict=False))
    hits = [f"CASE WHEN `{value}` BETWEEN {low} AND {high} THEN {i} END" for i, (low, high) in spans]
    return F.expr(f"array({', '.join(hits)})")


def interval_members(df: DataFrame, value: str, edges: list[float], out: str = "bin") -> DataFrame:
    """One row per row and interval: a value on an inner edge lies in both neighbours."""
    return df.withColumn(out, F.explode(interval_of(value, edges))).where(F.col(out).isNotNull())


def nearest_to_median(
    df: DataFrame, value: str, tie: str, edges: list[float], medians: list[float | None], k: int = 2
) -> DataFrame:
    """The `k` rows of each interval closest to its median, ties by `tie`.

    The rank filter is applied in every input partition before rows move.
    """
    middle = F.lit([float("nan") if m is None else m for m in medians])
    near = interval_members(df, value, edges).withColumn(
        "distance", F.abs(F.col(value) - F.get(middle, F.col("bin")))
    )
    closest = W.partitionBy("bin").orderBy("distance", tie)
    return near.withColumn("place", F.row_number().over(closest)).where(F.col("place") <= k)


def extremes(df: DataFrame, value: str, tie: str) -> DataFrame:
    """The row with the smallest and the row with the largest value, first by `tie`."""
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*df.columns).alias("row"))
    x, t = F.col(f"row.{value}"), F.col(f"row.{tie}")
    ends = rows.agg(
        F.min_by("row", F.struct(x, t)).alias("low"), F.min_by("row", F.struct(-x, t)).alias("high")
    )
    both = F.array(
        F.struct(F.lit("min").alias("kind"), F.col("low").alias("row")),
        F.struct(F.lit("max").alias("kind"), F.col("high").alias("row")),
    )
    return ends.select(F.inline(both)).where("row is not null").select("kind", "row.*")


def pick_exemplars(
    df: DataFrame,
    value: str,
    tie: str,
    points: list[float] = DECILES,
    per_interval: int = 2,
    dedupe: bool = False,
) -> DataFrame:
    """Extremes plus the rows next to each interval median; a row may appear more than once."""
    stats = OrderStatistics(df, value)
    if not stats.n:
        return extremes(df, value, tie)
    edges, medians = stats.intervals(points)
    near = nearest_to_median(df, value, tie, edges, medians, per_interval)
    rows = extremes(df, value, tie).unionByName(
        near.select(F.concat(F.lit("bin"), F.col("bin").cast("string")).alias("kind"), *df.columns)
    )
    return rows.dropDuplicates([tie]) if dedupe else rows
