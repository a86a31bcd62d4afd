"""Order statistics of every group of a table at once: exact by one sort, or by sketches that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propflow.operators.ordering import range_sorted

QUARTILES = [0.25, 0.5, 0.75]
SKETCH_SIZE = 200


def _long(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group as _g0.., column, _x): one row per group and value, nulls and NaN left out."""
    values = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x")) for c in columns))
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    return df.select(*keys, F.inline(values)).where("_x is not null and not isnan(_x)")


def grouped_quantiles(df: DataFrame, group: list[str], columns: list[str], points: list[float] = QUARTILES) -> DataFrame:
    """(group.., column, n, point, value): linearly interpolated quantiles of each column in each group.

    Equal values of a group are counted before they move. One range sort by column, group and value
    serves all columns; a group that fills many range partitions is counted partition by partition,
    and only its count per partition meets in one place. Null groups are a group; a group whose
    values are all null has no row.
    """
    keys = ["column", *(f"_g{i}" for i in range(len(group)))]
    counts = _long(df, group, columns).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    ordered = range_sorted(counts, *keys, "_x")
    local = W.partitionBy("_part", *keys).orderBy("_x")
    placed = ordered.withColumn("_to", F.sum("_c").over(local))
    pieces = ordered.groupBy("_part", *keys).agg(F.sum("_c").alias("_n"))
    whole = W.partitionBy(*keys)  # a row per range partition that the group meets
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.select("_part", *keys, before.alias("_before"), F.sum("_n").over(whole).alias("_total"))
    renamed = offsets.toDF("_at", *(f"_k{i}" for i in range(len(keys))), "_before", "_total")
    same = [F.col("_part") == F.col("_at"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))]
    rows = placed.join(renamed, same)
    end = F.col("_before") + F.col("_to")
    first = end - F.col("_c")
    spots = F.transform(F.array(*map(F.lit, points)), lambda p: F.struct(p.alias("point"), (p * (F.col("_total") - 1)).alias("spot")))

    def holds(rank: Column) -> Column:
        return (rank >= first) & (rank < end)

    def lower(spot: Column) -> Column:
        return F.floor(spot)

    def upper(spot: Column) -> Column:
        return F.least(F.floor(spot) + 1, F.col("_total") - 1)

    asked = F.filter(spots, lambda s: holds(lower(s["spot"])) | holds(upper(s["spot"])))
    hits = F.transform(
        asked,
        lambda s: F.struct(
            s["point"].alias("point"),
            (s["spot"] - F.floor(s["spot"])).alias("share"),
            F.when(holds(lower(s["spot"])), F.col("_x")).alias("low"),
            F.when(holds(upper(s["spot"])), F.col("_x")).alias("high"),
        ),
    )
    found = rows.select(*keys, F.col("_total").alias("n"), F.inline(hits)).groupBy(*keys, "n", "point", "share").agg(
        F.max("low").alias("low"), F.max("high").alias("high")
    )
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    names = [F.col(f"_g{i}").alias(c) for i, c in enumerate(group)]
    return found.select(*names, "column", "n", "point", value.alias("value"))


def quantile_sketches(df: DataFrame, group: list[str], columns: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """(group.., column, n, sketch): a mergeable KLL sketch per group and column, some kilobytes each.

    The approximate form: with the default size a quantile's rank is off by about 1.3 % of the rows.
    """
    sketches = _long(df, group, columns).groupBy(*(f"_g{i}" for i in range(len(group))), "column").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_x", size).alias("sketch")
    )
    return sketches.toDF(*group, "column", "n", "sketch")


def merge_sketches(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of finer groups, or of several days, as sketches of `group`."""
    return sketches.groupBy(*group, "column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, points: list[float] = QUARTILES) -> DataFrame:
    """The sketches' rows with (point, value) in place of the sketch."""
    values = [F.struct(F.lit(p).alias("point"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("value")) for p in points]
    return sketches.select("*", F.inline(F.array(*values))).drop("sketch")
