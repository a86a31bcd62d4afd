"""Two estimates of one quantity: gap, recomputation from the surer one, combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from propflow.fixed_values import CONFIDENCE_GAP
from propflow.functions.numbers import convert_units


def confidence_gap(df: DataFrame, a: str, b: str, gap: float = CONFIDENCE_GAP) -> DataFrame:
    """Rows whose confidences differ by more than `gap`, with `confidence_difference`."""
    difference = F.col(a) - F.col(b)
    return df.withColumn("confidence_difference", difference).where(F.abs(difference) > gap)


def attach_weights(df: DataFrame, weights: DataFrame, key: str, weight: str = "molecular_weight") -> DataFrame:
    """Adds the molecular weight per key, null where the table has none."""
    unique = weights.groupBy(key).agg(F.min(weight).alias(weight))
    return df.join(unique, key, "left")


def recompute_weaker(
    df: DataFrame,
    pred_mg: str = "pred_lc50_4hr_mg_L",
    pred_ppm: str = "pred_lc50_4hr_ppm",
    conf_mg: str = "confidence_mgL",
    conf_ppm: str = "confidence_ppm",
    weight: str = "molecular_weight",
) -> DataFrame:
    """Recalculates the less confident unit from the other and prefers it in the combined columns."""
    from_mg = F.col(conf_mg) > F.col(conf_ppm)
    new_ppm = F.when(from_mg, convert_units(F.col(pred_mg), F.col(weight), "mg/L"))
    new_mg = F.when(~from_mg, convert_units(F.col(pred_ppm), F.col(weight), "ppm"))
    return df.withColumns({"recalculated_ppm": new_ppm, "recalculated_mg_L": new_mg}).withColumns(
        {
            "combined_ppm": F.coalesce("recalculated_ppm", pred_ppm),
            "combined_mg_L": F.coalesce("recalculated_mg_L", pred_mg),
        }
    )
