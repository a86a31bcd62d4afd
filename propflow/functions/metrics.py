"""Aggregate expressions that judge a numeric prediction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def regression_metrics(actual: Column, predicted: Column, digits: int | None = None) -> list[Column]:
    """n, corr, mae, rmse and r2 over the pairs without nulls, all in one aggregation."""
    complete = actual.isNotNull() & predicted.isNotNull()
    a, p = F.when(complete, actual), F.when(complete, predicted)
    gap = a - p
    # F.corr divides by zero on a constant column
    pearson = F.try_divide(F.covar_pop(a, p), F.stddev_pop(a) * F.stddev_pop(p))
    spread = F.var_pop(a) * F.count(a)
    columns = {
        "corr": pearson,
        "mae": F.avg(F.abs(gap)),
        "rmse": F.sqrt(F.avg(gap * gap)),
        "r2": 1 - F.try_divide(F.sum(gap * gap), spread),
    }
    if digits is not None:
        columns = {name: F.round(column, digits) for name, column in columns.items()}
    return [F.count(a).alias("n"), *(column.alias(name) for name, column in columns.items())]


def in_domain(confidence: Column, threshold: float) -> Column:
    """1 for a confidence at or above the threshold, 0 below it or for none."""
    return F.coalesce((confidence >= threshold).cast("int"), F.lit(0))


def reached_thresholds(confidence: Column, thresholds: list) -> Column:
    """Each threshold the confidence reaches, null in place of the others."""
    return F.array(*(F.when(confidence >= t, F.lit(t)) for t in thresholds))
