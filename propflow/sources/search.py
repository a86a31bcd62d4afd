"""Stored web-search responses as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from propflow.fixed_values import LICENSE_RULE

RESPONSE_SCHEMA = (
    "webPages struct<value: array<struct<name: string, url: string, snippet: string,"
    " contractualRules: array<struct<_type: string, license: struct<name: string, url: string>>>>>>"
)


def flatten_responses(df: DataFrame, query: str, response: str) -> DataFrame:
    """One row per hit; the first license rule of a hit names its license, else ''."""
    body = F.from_json(F.col(response), RESPONSE_SCHEMA)
    hits = df.select(F.col(query).alias("query"), F.explode(body["webPages"]["value"]).alias("hit"))

    def license_field(name: str) -> Column:
        rules = F.filter("hit.contractualRules", lambda rule: rule["_type"] == LICENSE_RULE)
        return F.coalesce(F.get(rules, F.lit(0))["license"][name], F.lit(""))

    return hits.select(
        "query",
        "hit.name",
        "hit.url",
        "hit.snippet",
        license_field("name").alias("license_name"),
        license_field("url").alias("license_url"),
    )
