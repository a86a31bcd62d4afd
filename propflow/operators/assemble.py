"""Long (entity, property, value) tables from wide and from annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from propflow.fixed_values import STRUCTURE_PROPERTY
from propflow.functions.symbols import split_symbols
from propflow.sources.tables import union_parts


def melt(
    df: DataFrame,
    ids: list[str],
    labels: dict[str, str],
    name: str = "property",
    value: str = "value",
    keep_null: bool = True,
) -> DataFrame:
    """One row per entity and endpoint, the column name replaced by its label."""
    long = df.select(*ids, *labels).unpivot(ids, list(labels), name, value)
    if not keep_null:
        long = long.where(F.col(value).isNotNull())
    mapping = F.create_map(*(F.lit(part) for pair in labels.items() for part in pair))
    return long.withColumn(name, mapping[F.col(name)])


def structures(eav: DataFrame, entity: str, wanted: str = STRUCTURE_PROPERTY) -> DataFrame:
    """(entity, smiles) rows of an entity-property-value table."""
    rows = eav.where(F.col("property") == wanted)
    return rows.select(F.col("id").try_cast("long").alias(entity), F.col("value").alias("smiles")).where(
        F.col(entity).isNotNull()
    )


def assemble_union(labelled: DataFrame, measured: DataFrame) -> DataFrame:
    """Both long tables by column name, values as strings, nulls left out."""
    text = F.col("value").cast("string")
    rows = union_parts(labelled.withColumn("value", text), measured.withColumn("value", text))
    return rows.where("value is not null")


def assemble_property_table(
    compounds: DataFrame,
    labelled: DataFrame,
    measured: DataFrame,
    entity: str,
    alt_id: str,
    symbols: str,
) -> DataFrame:
    """Annotation and measurement rows of the compounds that have a symbol string, symbols split."""
    known = compounds.select(entity, symbols).where(F.col(symbols).isNotNull())
    rows = assemble_union(labelled, measured.where(F.col(entity).isNotNull()))
    parts = split_symbols(F.col(symbols)).alias("symbols_split")
    return rows.join(known, entity).select(entity, alt_id, symbols, parts, "property", "value")
