"""Signed-number labels, guarded logs and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from propflow.fixed_values import LITRES_PER_MOLE


def encode_number(x: Column) -> Column:
    """`positive 2.3` / `negative 2.3` with one decimal; null stays null, zero is positive."""
    rounded = F.round(x.cast("double"), 1)
    sign = F.when(rounded < 0, F.lit("negative ")).otherwise(F.lit("positive "))
    return F.concat(sign, F.abs(rounded).cast("string"))


def decode_number(label: Column) -> Column:
    """The number of a label whose sign word may have lost leading letters; else null."""
    word = F.regexp_extract(label, r"^\s*([a-z]*)\s*[-+]?[0-9.]", 1)
    digits = F.regexp_extract(label, r"^\s*[a-z]*\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*$", 1)
    number = digits.try_cast("double")
    # "tive" ends both words, so a sign can be told only from a longer tail
    return (
        F.when(word == "", number)
        .when(F.lit("positive").endswith(word) & ~F.lit("negative").endswith(word), number)
        .when(F.lit("negative").endswith(word) & ~F.lit("positive").endswith(word), -number)
    )


def guarded_log10(x: Column, divisor: float = 1.0, floor: Column | float | None = None) -> Column:
    """log10(x / divisor) of a positive x.

    Without a floor other values give null; with one they give log10(floor) and
    only null stays null.
    """
    usable = F.log10(x / F.lit(divisor))
    if floor is None:
        return F.when(x > 0, usable)
    bottom = F.log10(floor if isinstance(floor, Column) else F.lit(floor))
    return F.when(x > 0, usable).when(x.isNotNull(), bottom)


def guarded_confidence(x: Column, confidence: Column, floor: bool = False) -> Column:
    """The confidence of a usable estimate; 0 where the log guard gave null."""
    usable = x.isNotNull() if floor else x > 0
    return F.when(usable, F.coalesce(confidence, F.lit(0))).otherwise(F.lit(0))


def mg_per_m3(log_mg_per_l: Column) -> Column:
    return F.pow(F.lit(10.0), log_mg_per_l) * 1000


def ppm(log_ppm: Column) -> Column:
    return F.pow(F.lit(10.0), log_ppm)


def fixed4(x: Column) -> Column:
    """Four decimals as text, rounded before it is formatted."""
    return F.when(x.isNotNull(), F.format_string("%.4f", F.round(x, 4)))


def convert_units(log_value: Column, weight: Column, from_unit: str) -> Column:
    """log10 mg/L to log10 ppm (`from_unit="mg/L"`) or back (`"ppm"`); null without a weight."""
    usable = F.when(weight > 0, weight)
    scale = F.lit(LITRES_PER_MOLE * 1000)
    plain = F.pow(F.lit(10.0), log_value)
    if from_unit == "mg/L":
        return F.log10(F.try_divide(plain * scale, usable))
    if from_unit == "ppm":
        return F.log10(F.try_divide(plain * usable, scale))
    raise ValueError(f"unit {from_unit!r} is neither 'mg/L' nor 'ppm'")
