"""Structured model responses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RESPONSE_SCHEMA = (
    "chemical_name string, units string, explanation string, lc50 double, confidence double"
)


def parse_response(response: Column) -> Column:
    """The response as a struct; unreadable text gives null fields and confidence 0."""
    parsed = F.from_json(response, RESPONSE_SCHEMA)
    return F.struct(
        parsed["chemical_name"].alias("chemical_name"),
        parsed["units"].alias("units"),
        parsed["explanation"].alias("explanation"),
        parsed["lc50"].alias("lc50"),
        F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"),
    )


def parse_short_response(response: Column, units: str) -> Column:
    """The two-field form `{"lc50_4hr_<units>": number, "confidence": number}`."""
    field = f"lc50_4hr_{units}"
    parsed = F.from_json(response, f"`{field}` double, confidence double")
    return F.struct(
        parsed[field].alias("lc50"),
        F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"),
    )


def memo_key(function: str, version: str, *arguments: str) -> Column:
    """md5 of the function name, its version and the named argument columns as JSON."""
    call = F.struct(
        F.lit(function).alias("function"),
        F.lit(version).alias("version"),
        *(F.col(name).alias(name) for name in arguments),
    )
    return F.md5(F.to_json(call, {"ignoreNullFields": "false"}))
