"""The given tables in the shapes the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from propflow.fixed_values import CROSSWALK_SOURCE
from propflow.sources.tables import read_table


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", *columns)


# The annotation columns as SQL both engines read; `{k}` is each engine's JSON access.
ANNOTATION_COLUMNS = {
    "event_id": "event_id",
    "pub_chem_cid": """CASE WHEN event_type = 'click' AND value > 50 THEN {list}(user_id, user_id + 1)
        ELSE {list}(user_id) END""",
    "source_name": f"""CASE event_type WHEN 'signup' THEN '{CROSSWALK_SOURCE}'
        ELSE concat('Source ', event_type) END""",
    "heading": "event_type",
    "data": """CASE event_type
        WHEN 'signup' THEN concat('{{"Value":{{"StringWithMarkup":[{{"String":"DTXSID', {k}, '"}}]}}}}')
        WHEN 'click' THEN concat('{{"Name":"clicks","Value":{{"Number":[', {k}, ',0]}}}}')
        WHEN 'view' THEN concat('{{"Name":"view of ', user_id,
          '","Value":{{"StringWithMarkup":[{{"String":"seen ', {k}, '"}},{{"Markup":1}},{{"String":"times"}}]}}}}')
        WHEN 'purchase' THEN concat('{{"Name":"amount","Value":{{"Number":[', value, ']}}}}')
        ELSE CASE WHEN value < 10 THEN concat('not json ', {k}) ELSE '{{"Value":{{"Boolean":[true]}}}}' END
      END""",
}


def _annotation_columns(k: str, list_of: str) -> list[str]:
    return [f"{sql.format(k=k, list=list_of)} AS {name}" for name, sql in ANNOTATION_COLUMNS.items()]


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as annotation rows: id list, source, heading, JSON payload."""
    events = table(spark, sf, "events", "event_id", "user_id", "event_type", "value", "props")
    return events.selectExpr(*_annotation_columns("get_json_object(props, '$.k')", "array"))


ANNOTATIONS_SQL = """
ann AS (SELECT {columns} FROM events),
parsed AS (
  SELECT *, json_valid(data) AS ok,
    CASE WHEN json_valid(data) THEN json_extract_string(data, '$.Value.Number[0]') END AS num,
    CASE WHEN json_valid(data) AND json_extract(data, '$.Value.StringWithMarkup') IS NOT NULL
         THEN array_to_string(json_extract_string(data, '$.Value.StringWithMarkup[*].String'), ' ') END AS txt,
    CASE WHEN json_valid(data) THEN coalesce(json_extract_string(data, '$.Name'), '') ELSE '' END AS name
  FROM ann),
valued AS (SELECT *, coalesce(num, txt) AS value_text FROM parsed)
""".format(
    columns=", ".join(_annotation_columns("json_extract_string(props, '$.k')", "list_value"))
)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as measured and predicted log10 values with confidences."""
    lines = table(
        spark, sf, "lineitem",
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    return lines.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.log10("l_extendedprice").alias("actual_mg"),
        F.log10(F.col("l_quantity") * 1500).alias("pred_mg"),
        (F.lit(1) + F.col("l_linenumber")).alias("conf_mg"),
        F.log10(F.col("l_extendedprice") * 2).alias("actual_ppm"),
        F.when(F.col("l_discount") > 0, F.log10(F.col("l_quantity") * 3000 * (1 + F.col("l_tax")))).alias(
            "pred_ppm"
        ),
        F.when(F.col("l_discount") > 0, F.round(F.col("l_discount") * 100).cast("int")).alias("conf_ppm"),
    )


PREDICTIONS_SQL = """
pred AS (
  SELECT l_orderkey, l_partkey, l_linenumber,
    log10(l_extendedprice) AS actual_mg,
    log10(l_quantity * 1500) AS pred_mg,
    1 + l_linenumber AS conf_mg,
    log10(l_extendedprice * 2) AS actual_ppm,
    CASE WHEN l_discount > 0 THEN log10(l_quantity * 3000 * (1 + l_tax)) END AS pred_ppm,
    CASE WHEN l_discount > 0 THEN CAST(round(l_discount * 100) AS INTEGER) END AS conf_ppm
  FROM lineitem)
"""


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as (key, molecular weight); a size below 3 has none."""
    size = F.col("p_size")
    weight = F.when(size >= 3, (size + 100).cast("double"))
    return table(spark, sf, "part", "p_partkey", "p_size").select(
        F.col("p_partkey").alias("l_partkey"), weight.alias("molecular_weight")
    )


WEIGHTS_SQL = """
weights AS (SELECT p_partkey AS l_partkey,
  CASE WHEN p_size >= 3 THEN CAST(p_size + 100 AS DOUBLE) END AS molecular_weight FROM part)
"""


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as measured entities: two log10 endpoints, one of them with gaps."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    price = F.col("o_totalprice")
    return orders.select(
        "o_orderkey",
        F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" "), F.col("o_orderpriority")).alias("name"),
        F.log10(price / 1000).alias("mg"),
        F.when(F.col("o_orderstatus") != "F", F.log10(price / 50)).alias("ppm"),
    )


MEASUREMENTS_SQL = """
meas AS (
  SELECT o_orderkey, concat('order ', o_orderkey, ' ', o_orderpriority) AS name,
    log10(o_totalprice / 1000) AS mg,
    CASE WHEN o_orderstatus <> 'F' THEN log10(o_totalprice / 50) END AS ppm
  FROM orders)
"""


def compounds(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as symbol strings: a bracket per name word, a dot, the brand."""
    words = F.regexp_replace("p_name", " ", "][")
    brand = F.col("p_brand")
    return table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type").select(
        "p_partkey",
        F.concat(F.lit("["), words, F.lit("].["), brand, F.lit("]")).alias("symbols"),
        F.col("p_type").alias("property"),
        brand.alias("value"),
    )


COMPOUNDS_SQL = """
comp AS (
  SELECT p_partkey, concat('[', replace(p_name, ' ', ']['), '].[', p_brand, ']') AS symbols,
    p_type AS property, p_brand AS value
  FROM part)
"""
