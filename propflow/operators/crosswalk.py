"""Id lists, the id crosswalk and joins through it.

Joins carry no broadcast hint: Spark broadcasts a side below its size limit and
otherwise sorts and merges, splitting hot keys through adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from propflow.fixed_values import CROSSWALK_SOURCE


def unwrap_singletons(df: DataFrame, ids: str, out: str | None = None) -> DataFrame:
    """Rows whose id list holds exactly one id, the list replaced by that id."""
    return df.where(F.size(ids) == 1).withColumn(out or ids, F.get(ids, F.lit(0)))


def build_crosswalk(
    annotations: DataFrame,
    entity: str,
    value: str,
    source: str = "source_name",
    wanted: str = CROSSWALK_SOURCE,
    out: str = "dsstox",
) -> DataFrame:
    """Distinct (entity, external id) pairs of the one source that names external ids."""
    rows = annotations.where(F.col(source) == wanted)
    return rows.select(entity, F.col(value).alias(out)).distinct()


def duplicate_keys(crosswalk: DataFrame, key: str) -> DataFrame:
    """Keys with more than one partner, and how many."""
    counts = crosswalk.groupBy(key).agg(F.count(F.lit(1)).alias("partners"))
    return counts.where("partners > 1")


def attach_ids(
    df: DataFrame, crosswalk: DataFrame, key: str, how: str = "left", strict: bool = False
) -> DataFrame:
    """Join to the crosswalk; several partners multiply rows unless `strict` forbids it."""
    if strict and not duplicate_keys(crosswalk, key).isEmpty():
        raise ValueError(f"crosswalk is not unique per {key}")
    return df.join(crosswalk, key, how)


def keep_known(df: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose key is among the ids."""
    known = ids.select(F.col(id_column).alias(key)).distinct()
    return df.join(known, key, "left_semi")


def overlap_count(left: DataFrame, left_id: str, right: DataFrame, right_id: str) -> DataFrame:
    """How many distinct trimmed ids both sides share, as one row."""

    def ids(df: DataFrame, column: str) -> DataFrame:
        text = F.regexp_replace(F.col(column).cast("string"), r"^\s+|\s+$", "")
        return df.select(text.alias("id")).where("id is not null").distinct()

    shared = ids(left, left_id).join(ids(right, right_id), "id", "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("overlap"))


def first_seen(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first `n` distinct keys in order of first appearance."""
    firsts = df.groupBy(key).agg(F.min(order).alias("first_seen"))
    return firsts.orderBy("first_seen", key).limit(n)


def name_join(rows: DataFrame, named: DataFrame, on: str, how: str, null_safe: bool = False) -> DataFrame:
    """Join on a display name; null names meet only when `null_safe`."""
    if not null_safe:
        return rows.join(named, on, how)
    other = named.withColumnRenamed(on, "_name")
    return rows.join(other, F.col(on).eqNullSafe(F.col("_name")), how).drop("_name")


def label_rows(
    annotations: DataFrame, keep: Column, entity: str, label: Column, value: str
) -> DataFrame:
    """(entity, property, value) of the annotation rows that `keep` accepts."""
    return annotations.where(keep).select(entity, label.alias("property"), F.col(value).alias("value"))
