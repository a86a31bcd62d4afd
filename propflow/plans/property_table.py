"""From raw annotations, measurements and structures to one long property table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from propflow.fixed_values import ENDPOINT_LABELS
from propflow.functions.annotation import property_label, with_annotation_value
from propflow.functions.keywords import matches_keywords
from propflow.operators.assemble import assemble_property_table, melt, structures
from propflow.operators.crosswalk import label_rows, unwrap_singletons
from propflow.sources.tables import require_columns


def property_table(
    annotations: DataFrame,
    measurements: DataFrame,
    eav: DataFrame,
    keywords: list[str],
    to_symbols: Callable[[Column], Column],
    endpoints: dict[str, str] = ENDPOINT_LABELS,
    entity: str = "pub_chem_cid",
    alt_id: str = "dsstox_substance_id",
) -> DataFrame:
    """(entity, alt_id, symbols, symbols_split, property, value) of entities with a structure.

    `measurements` carries both ids; `to_symbols` turns a structure column into a
    symbol string column (see `safe_codec` for a Python codec).
    """
    require_columns(annotations, entity, "source_name", "heading", "data")
    wanted = annotations.where(matches_keywords(F.col("heading"), keywords))
    valued = with_annotation_value(unwrap_singletons(wanted, entity), "data")
    label = property_label(F.col("source_name"), F.col("heading"), F.col("data"))
    labelled = label_rows(valued, F.col("value_text").isNotNull(), entity, label, "value_text")
    measured = melt(measurements, [entity, alt_id], endpoints, keep_null=False)
    compounds = structures(eav, entity).withColumn("symbols", to_symbols(F.col("smiles")))
    return assemble_property_table(compounds, labelled, measured, entity, alt_id, "symbols")
