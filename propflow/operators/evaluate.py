"""Records, flags and metrics of numeric predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from propflow.fixed_values import CONFIDENCE_THRESHOLDS
from propflow.functions.metrics import in_domain, reached_thresholds, regression_metrics
from propflow.functions.numbers import guarded_confidence, guarded_log10
from propflow.operators.ordering import OrderStatistics


def prediction_records(
    estimates: DataFrame,
    entity: str,
    name: str,
    mg: str,
    ppm: str,
    confidence_mg: str,
    confidence_ppm: str,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Log10 estimates (mg/m3 given, mg/L kept), confidences and an availability flag.

    An estimate that is null or not positive gives null and confidence 0.
    """
    log_mg, log_ppm = guarded_log10(F.col(mg), 1000.0), guarded_log10(F.col(ppm))
    return estimates.select(
        F.col(entity).alias("dsstox"),
        F.col(name).alias("chemical_name"),
        log_mg.alias("pred_lc50_4hr_mg_L"),
        log_ppm.alias("pred_lc50_4hr_ppm"),
        guarded_confidence(F.col(mg), F.col(confidence_mg)).alias("confidence_mgL"),
        guarded_confidence(F.col(ppm), F.col(confidence_ppm)).alias("confidence_ppm"),
        (log_mg.isNotNull() | log_ppm.isNotNull()).alias("prediction_available"),
        *keep,
    )


def with_domain_flag(df: DataFrame, confidence: str, threshold: float, out: str) -> DataFrame:
    return df.withColumn(out, in_domain(F.col(confidence), threshold))


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the non-null values."""
    rows = df.where(F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None, digits: int | None = None):
    """One metric row, or one per group."""
    return df.groupBy(*(by or [])).agg(*regression_metrics(F.col(actual), F.col(predicted), digits))


def _stacked(df: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """One output row per tuple of columns and input row, in one scan."""
    cells = [cell if isinstance(cell, Column) else F.lit(cell) for row in rows for cell in row]
    return df.select(F.stack(F.lit(len(rows)), *cells).alias(*names))


def threshold_sweep(
    df: DataFrame,
    units: dict[str, tuple[str, str, str]],
    thresholds: list = CONFIDENCE_THRESHOLDS,
    digits: int | None = None,
) -> DataFrame:
    """Metrics per unit of the rows at or above each threshold, in one scan.

    `units` maps a unit to its (actual, predicted, confidence) columns. Rows fan out
    to the thresholds they reach and are aggregated before they move.
    """
    rows = [
        (unit, F.col(actual).cast("double"), F.col(predicted).cast("double"), F.col(confidence).cast("double"))
        for unit, (actual, predicted, confidence) in units.items()
    ]
    long = _stacked(df, ["unit", "actual", "predicted", "confidence"], rows)
    reached = F.explode(reached_thresholds(F.col("confidence"), thresholds)).alias("threshold")
    cells = long.select("unit", "actual", "predicted", reached).where("threshold is not null")
    return metrics(cells, "actual", "predicted", ["unit", "threshold"], digits)


def compare_versions(
    df: DataFrame, pairs: dict[tuple[str, str], tuple[str, str]], digits: int | None = None
) -> DataFrame:
    """Metrics per (unit, version); `pairs` maps those to (actual, predicted) columns."""
    rows = [
        (unit, version, F.col(actual).cast("double"), F.col(predicted).cast("double"))
        for (unit, version), (actual, predicted) in pairs.items()
    ]
    long = _stacked(df, ["unit", "version", "actual", "predicted"], rows)
    return metrics(long, "actual", "predicted", ["unit", "version"], digits)


def describe_numeric(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """One row per column: count, mean, sample deviation, exact quartiles, extremes."""
    figures = []
    for name in columns:
        low, middle, high = OrderStatistics(df, name).quantiles([0.25, 0.5, 0.75]) or [None] * 3
        x = F.col(name).cast("double")
        row = {
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "min": F.min(x),
            "q25": F.lit(low).cast("double"),
            "q50": F.lit(middle).cast("double"),
            "q75": F.lit(high).cast("double"),
            "max": F.max(x),
        }
        rounded = [F.round(figure, digits).alias(label) for label, figure in row.items()]
        figures.append(F.struct(F.lit(name).alias("column_name"), F.count(x).alias("n"), *rounded))
    return df.agg(F.array(*figures).alias("figures")).select(F.inline("figures"))


def value_range(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value of a log10 column, back-transformed."""
    power = {"low": F.min(column), "high": F.max(column)}
    return df.agg(*(F.pow(F.lit(10.0), x).alias(label) for label, x in power.items()))


def submission_sheet(
    entities: DataFrame,
    predictions: DataFrame,
    key: str,
    ids: list[str],
    order: str,
    prediction: str,
    confidence: str,
    threshold: float = 7,
) -> DataFrame:
    """Every entity with its prediction, domain flag and confidence; `order` keeps the row order."""
    joined = entities.select(order, *ids).join(predictions.select(key, prediction, confidence), key, "left")
    flag = in_domain(F.col(confidence), threshold).alias("APPLICABILITY_DOMAIN")
    return joined.select(order, *ids, prediction, flag, F.col(confidence).alias("CONFIDENCE"))
