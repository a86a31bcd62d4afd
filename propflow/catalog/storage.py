"""Round trips through the sinks and the submission sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from propflow.catalog.standin import compounds, table
from propflow.functions.numbers import guarded_log10
from propflow.functions.symbols import split_symbols
from propflow.operators.evaluate import submission_sheet
from propflow.session import scratch_path
from propflow.sources.sinks import compact_parts, write_lookup, write_sheet, write_table
from propflow.sources.tables import read_sheet, read_table


def parquet_roundtrip(spark, sf):
    """Parts with a ragged symbol array, written as many files and compacted."""
    rows = compounds(spark, sf).withColumn("parts", split_symbols(F.col("symbols")))
    parts = write_table(rows, scratch_path(spark, "parts"), files=4)
    stored = read_table(spark, compact_parts(spark, parts, scratch_path(spark, "compact")))
    return stored.withColumn("parts", F.array_join("parts", "|"))


def csv_roundtrip(spark, sf):
    turns = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    columns = ["conv_id", "role", "turn", "text"]
    path = write_sheet(turns, scratch_path(spark, "sheet"), columns)
    return read_sheet(spark, path, "conv_id bigint, role string, turn bigint, text string")


def indexed_roundtrip(spark, sf):
    """Documents laid out by source, then all rows of one source looked up."""
    documents = table(spark, sf, "documents", "doc_id", "lang", "source", "text")
    path = write_lookup(documents, scratch_path(spark, "lookup"), "source", ["doc_id"])
    return read_table(spark, path).where("source = 'src7'")


def sheet(spark, sf):
    """Customers with a prediction from their orders, confidence from how many there are."""
    price = guarded_log10(F.avg("o_totalprice"), 1000.0)
    predictions = table(spark, sf, "orders", "o_custkey", "o_totalprice").groupBy(
        F.col("o_custkey").alias("c_custkey")
    ).agg(F.round(price, 6).alias("prediction"), F.count(F.lit(1)).alias("confidence"))
    entities = table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment").withColumn(
        "ord", F.col("c_custkey") + 1
    )
    return submission_sheet(
        entities, predictions, "c_custkey", ["c_custkey", "c_name", "c_mktsegment"], "ord",
        "prediction", "confidence", 10,
    )


QUERIES = {
    "parquet_roundtrip": parquet_roundtrip,
    "csv_roundtrip": csv_roundtrip,
    "indexed_roundtrip": indexed_roundtrip,
    "submission_sheet": sheet,
}

ORACLE = {
    "parquet_roundtrip": """
SELECT p_partkey, concat('[', replace(p_name, ' ', ']['), '].[', p_brand, ']') AS symbols,
  p_type AS property, p_brand AS value, concat('[', replace(p_name, ' ', ']|['), ']|.|[', p_brand, ']') AS parts
FROM part
""",
    "csv_roundtrip": "SELECT conv_id, role, turn, text FROM conversations",
    "indexed_roundtrip": "SELECT doc_id, lang, source, text FROM documents WHERE source = 'src7'",
    "submission_sheet": """
WITH p AS (SELECT o_custkey, round(log10(avg(o_totalprice) / 1000), 6) AS prediction, count(*) AS confidence
  FROM orders GROUP BY o_custkey)
SELECT c_custkey + 1 AS ord, c_custkey, c_name, c_mktsegment, prediction,
  CASE WHEN confidence >= 10 THEN 1 ELSE 0 END AS "APPLICABILITY_DOMAIN", confidence AS "CONFIDENCE"
FROM customer LEFT JOIN p ON o_custkey = c_custkey
""",
}
