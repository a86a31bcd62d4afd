"""Expressions over the JSON payload of an annotation row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MARKUP_SCHEMA = "Value struct<StringWithMarkup: array<struct<String: string>>>"


def annotation_text(payload: Column) -> Column:
    """First number as written, else the joined strings of the markup list, else null."""
    number = F.get_json_object(payload, "$.Value.Number[0]")
    no_numbers = F.get_json_object(payload, "$.Value.Number").isNull()
    items = F.from_json(payload, MARKUP_SCHEMA)["Value"]["StringWithMarkup"]
    strings = F.filter(F.transform(items, lambda i: i["String"]), lambda s: s.isNotNull())
    return F.coalesce(number, F.when(no_numbers, F.array_join(strings, " ")))


def is_bad_payload(payload: Column) -> Column:
    """True for text that is no JSON object."""
    return payload.isNotNull() & F.get_json_object(payload, "$").isNull()


def with_annotation_value(df: DataFrame, payload: str) -> DataFrame:
    """Adds `value_text`, `value_num` (null unless numeric) and `bad_record`."""
    text = annotation_text(F.col(payload))
    return df.withColumns(
        {
            "value_text": text,
            "value_num": text.try_cast("double"),
            "bad_record": F.coalesce(is_bad_payload(F.col(payload)), F.lit(False)),
        }
    )


def property_label(source: Column, heading: Column, payload: Column) -> Column:
    """`source - heading - name`, the name being '' when the payload has none."""
    name = F.coalesce(F.get_json_object(payload, "$.Name"), F.lit(""))
    return F.concat_ws(" - ", source, heading, name)
