"""Metrics, flags, unit conversion and reconciliation of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from propflow.catalog.standin import PREDICTIONS_SQL, WEIGHTS_SQL, predictions, table, weights
from propflow.functions.numbers import convert_units, guarded_confidence, guarded_log10
from propflow.operators import evaluate
from propflow.operators.reconcile import attach_weights, confidence_gap, recompute_weaker

PAIRS = {"mg": ("actual_mg", "pred_mg", "conf_mg"), "ppm": ("actual_ppm", "pred_ppm", "conf_ppm")}
NAMES = {"pred_mg": "pred_mg", "pred_ppm": "pred_ppm", "conf_mg": "conf_mg", "conf_ppm": "conf_ppm"}


def metrics_overall(spark, sf):
    pairs = {(unit, "all"): columns[:2] for unit, columns in PAIRS.items()}
    return evaluate.compare_versions(predictions(spark, sf), pairs, digits=6).drop("version")


def threshold_sweep(spark, sf):
    return evaluate.threshold_sweep(predictions(spark, sf), PAIRS, digits=6)


def value_counts(spark, sf):
    return evaluate.frequency_table(predictions(spark, sf), "conf_ppm")


def applicability_flag(spark, sf):
    rows = evaluate.with_domain_flag(predictions(spark, sf), "conf_mg", 6, "domain_mg")
    rows = evaluate.with_domain_flag(rows, "conf_ppm", 7, "domain_ppm")
    return rows.groupBy("conf_mg", "conf_ppm", "domain_mg", "domain_ppm").agg(F.count(F.lit(1)).alias("n"))


def describe_numeric(spark, sf):
    return evaluate.describe_numeric(predictions(spark, sf), ["actual_mg", "pred_ppm"])


def log_guard_null(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey").select(
        "c_custkey",
        F.round(guarded_log10(x, 1000.0), 6).alias("log_value"),
        guarded_confidence(x, F.col("c_nationkey")).alias("confidence"),
    )


def log_guard_floor(spark, sf):
    customers = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    floor = customers.where("c_acctbal > 0").agg(F.min("c_acctbal")).scalar()
    rows = customers.withColumn("floor", floor).withColumn("x", F.nullif(F.col("c_acctbal"), F.lit(0.0)))
    return rows.select(
        "c_custkey",
        F.round(guarded_log10(F.col("x"), floor=F.col("floor")), 6).alias("log_value"),
        guarded_confidence(F.col("x"), F.col("c_nationkey"), floor=True).alias("confidence"),
    )


def unit_conversion(spark, sf):
    rows = attach_weights(predictions(spark, sf), weights(spark, sf), "l_partkey")
    weight = F.col("molecular_weight")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        F.round(convert_units(F.col("pred_mg"), weight, "mg/L"), 6).alias("as_ppm"),
        F.round(convert_units(F.col("pred_ppm"), weight, "ppm"), 6).alias("as_mg"),
    )


def gap_rows(spark, sf):
    rows = confidence_gap(predictions(spark, sf), "conf_mg", "conf_ppm")
    return rows.select("l_orderkey", "l_linenumber", "conf_mg", "conf_ppm", "confidence_difference")


def _reconciled(spark, sf):
    gap = confidence_gap(predictions(spark, sf), "conf_mg", "conf_ppm")
    return recompute_weaker(attach_weights(gap, weights(spark, sf), "l_partkey"), **NAMES)


def recalc_combine(spark, sf):
    figures = ("recalculated_mg_L", "recalculated_ppm", "combined_mg_L", "combined_ppm")
    rounded = [F.round(c, 6).alias(c) for c in figures]
    return _reconciled(spark, sf).select("l_orderkey", "l_linenumber", *rounded)


def metrics_compare(spark, sf):
    pairs = {
        ("mg/L", "original"): ("actual_mg", "pred_mg"),
        ("mg/L", "combined"): ("actual_mg", "combined_mg_L"),
        ("ppm", "original"): ("actual_ppm", "pred_ppm"),
        ("ppm", "combined"): ("actual_ppm", "combined_ppm"),
    }
    return evaluate.compare_versions(_reconciled(spark, sf), pairs, digits=6)


QUERIES = {
    "metrics_overall": metrics_overall,
    "threshold_sweep": threshold_sweep,
    "value_counts": value_counts,
    "applicability_flag": applicability_flag,
    "describe_numeric": describe_numeric,
    "log_guard_null": log_guard_null,
    "log_guard_floor": log_guard_floor,
    "convert_units": unit_conversion,
    "confidence_gap": gap_rows,
    "recalc_combine": recalc_combine,
    "metrics_compare": metrics_compare,
}

METRICS_SQL = """
count(*) AS n, round(corr(a, p), 6) AS corr, round(avg(abs(a - p)), 6) AS mae,
round(sqrt(avg((a - p) * (a - p))), 6) AS rmse,
round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 6) AS r2
"""

UNITS_SQL = """
units AS (
  SELECT 'mg' AS unit, actual_mg AS a, pred_mg AS p, conf_mg AS c FROM pred
  UNION ALL SELECT 'ppm', actual_ppm, pred_ppm, conf_ppm FROM pred)
"""

RECONCILED_SQL = f"""
{PREDICTIONS_SQL}, {WEIGHTS_SQL},
gap AS (
  SELECT pred.*, molecular_weight AS mw FROM pred LEFT JOIN weights USING (l_partkey)
  WHERE abs(conf_mg - conf_ppm) > 1.5),
recalc AS (
  SELECT *,
    CASE WHEN conf_mg > conf_ppm THEN log10(pow(10, pred_mg) * 24.45 * 1000 / mw) END AS recalculated_ppm,
    CASE WHEN conf_mg <= conf_ppm THEN log10(pow(10, pred_ppm) * mw / (24.45 * 1000)) END AS recalculated_mg
  FROM gap),
combined AS (
  SELECT *, coalesce(recalculated_ppm, pred_ppm) AS combined_ppm,
    coalesce(recalculated_mg, pred_mg) AS combined_mg FROM recalc)
"""

ORACLE = {
    "metrics_overall": f"""
WITH {PREDICTIONS_SQL}, {UNITS_SQL}
SELECT unit, {METRICS_SQL} FROM units WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY unit
""",
    "threshold_sweep": f"""
WITH {PREDICTIONS_SQL}, {UNITS_SQL}
SELECT unit, threshold, {METRICS_SQL}
FROM units JOIN (VALUES (5), (6), (7), (8)) AS t(threshold) ON c >= threshold
WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY unit, threshold
""",
    "value_counts": f"""
WITH {PREDICTIONS_SQL}
SELECT conf_ppm AS value, count(*) AS n FROM pred WHERE conf_ppm IS NOT NULL GROUP BY conf_ppm
""",
    "applicability_flag": f"""
WITH {PREDICTIONS_SQL}
SELECT conf_mg, conf_ppm, CASE WHEN conf_mg >= 6 THEN 1 ELSE 0 END AS domain_mg,
  CASE WHEN conf_ppm >= 7 THEN 1 ELSE 0 END AS domain_ppm, count(*) AS n
FROM pred GROUP BY ALL
""",
    "describe_numeric": f"""
WITH {PREDICTIONS_SQL},
x AS (SELECT 'actual_mg' AS column_name, actual_mg AS v FROM pred
      UNION ALL SELECT 'pred_ppm', pred_ppm FROM pred)
SELECT column_name, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
  round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max
FROM x GROUP BY column_name
""",
    "log_guard_null": """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal / 1000), 6) END AS log_value,
  CASE WHEN c_acctbal > 0 THEN c_nationkey ELSE 0 END AS confidence
FROM customer
""",
    "log_guard_floor": """
WITH f AS (SELECT min(c_acctbal) AS floor FROM customer WHERE c_acctbal > 0)
SELECT c_custkey,
  CASE WHEN c_acctbal <> 0 THEN round(log10(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE floor END), 6)
    END AS log_value,
  CASE WHEN c_acctbal <> 0 THEN c_nationkey ELSE 0 END AS confidence
FROM customer, f
""",
    "convert_units": f"""
WITH {PREDICTIONS_SQL}, {WEIGHTS_SQL}
SELECT l_orderkey, l_linenumber,
  round(log10(pow(10, pred_mg) * 24.45 * 1000 / molecular_weight), 6) AS as_ppm,
  round(log10(pow(10, pred_ppm) * molecular_weight / (24.45 * 1000)), 6) AS as_mg
FROM pred LEFT JOIN weights USING (l_partkey)
""",
    "confidence_gap": f"""
WITH {PREDICTIONS_SQL}
SELECT l_orderkey, l_linenumber, conf_mg, conf_ppm, conf_mg - conf_ppm AS confidence_difference
FROM pred WHERE abs(conf_mg - conf_ppm) > 1.5
""",
    "recalc_combine": f"""
WITH {RECONCILED_SQL}
SELECT l_orderkey, l_linenumber, round(recalculated_mg, 6) AS "recalculated_mg_L",
  round(recalculated_ppm, 6) AS recalculated_ppm, round(combined_mg, 6) AS "combined_mg_L",
  round(combined_ppm, 6) AS combined_ppm
FROM combined
""",
    "metrics_compare": f"""
WITH {RECONCILED_SQL},
x AS (
  SELECT 'mg/L' AS unit, 'original' AS version, actual_mg AS a, pred_mg AS p FROM combined
  UNION ALL SELECT 'mg/L', 'combined', actual_mg, combined_mg FROM combined
  UNION ALL SELECT 'ppm', 'original', actual_ppm, pred_ppm FROM combined
  UNION ALL SELECT 'ppm', 'combined', actual_ppm, combined_ppm FROM combined)
SELECT unit, version, {METRICS_SQL} FROM x WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY unit, version
""",
}
