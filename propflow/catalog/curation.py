"""Annotation values, keyword filters, crosswalk joins, long tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from propflow.catalog.standin import ANNOTATIONS_SQL, COMPOUNDS_SQL, annotations, compounds, table
from propflow.fixed_values import CROSSWALK_SOURCE, TRAINING_TEXT
from propflow.functions.annotation import property_label, with_annotation_value
from propflow.functions.keywords import matches_in_all, matches_keywords
from propflow.functions.numbers import decode_number, encode_number
from propflow.operators.assemble import assemble_union, melt
from propflow.operators.crosswalk import (
    attach_ids,
    build_crosswalk,
    first_seen,
    keep_known,
    name_join,
    overlap_count,
    unwrap_singletons,
)
from propflow.plans.property_table import property_table
from propflow.sources.tables import vocabulary_of_json

KEYWORDS = ["the", "under (", "der die", "avec", "(5", "de la"]
REGEX_KEYWORDS = ["th.", "src(1|2)", "d.r", "e(s|n) "]
WORD_KEYWORDS = ["the", "and", "und", "555-1055", "que"]


def _literal(alias: str, words: list[str]) -> str:
    return " OR ".join(f"contains(lower({alias}), '{w}')" for w in words)


def annotation_value(spark, sf):
    rows = with_annotation_value(annotations(spark, sf), "data")
    return rows.select("event_id", "value_text", "value_num", "bad_record")


def singleton_unwrap(spark, sf):
    single = unwrap_singletons(annotations(spark, sf), "pub_chem_cid")
    return single.select("event_id", "pub_chem_cid", "heading")


def labels(spark, sf):
    label = property_label(F.col("source_name"), F.col("heading"), F.col("data"))
    return annotations(spark, sf).select("event_id", label.alias("property"))


def _documents(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text", "lang", "source")


def keyword_literal(spark, sf):
    return _documents(spark, sf).where(matches_keywords(F.col("text"), KEYWORDS)).select("doc_id", "lang")


def keyword_regex_two_col(spark, sf):
    heading = F.concat_ws(" ", "lang", "source")
    both = matches_in_all([heading, F.col("text")], REGEX_KEYWORDS, "regex")
    return _documents(spark, sf).where(both).select("doc_id", "source")


def keyword_word_bounded(spark, sf):
    hit = matches_keywords(F.col("text"), WORD_KEYWORDS, "word")
    return _documents(spark, sf).where(hit).select("doc_id", "lang")


def _valued(spark, sf):
    single = unwrap_singletons(annotations(spark, sf), "pub_chem_cid")
    return with_annotation_value(single, "data")


def _crosswalk(spark, sf):
    return build_crosswalk(_valued(spark, sf), "pub_chem_cid", "value_text")


def crosswalk_distinct(spark, sf):
    return _crosswalk(spark, sf)


def crosswalk_left(spark, sf):
    customers = table(spark, sf, "customer", "c_custkey", "c_name")
    return attach_ids(
        customers.withColumnRenamed("c_custkey", "pub_chem_cid"), _crosswalk(spark, sf), "pub_chem_cid"
    )


def crosswalk_inner(spark, sf):
    rows = _valued(spark, sf).select("event_id", "pub_chem_cid", "heading", "value_text")
    return attach_ids(rows, _crosswalk(spark, sf), "pub_chem_cid", "inner")


def semi_filter(spark, sf):
    documents = _documents(spark, sf).select("doc_id", "lang", "source")
    return keep_known(documents, "doc_id", table(spark, sf, "labels", "doc_id"), "doc_id")


def id_overlap(spark, sf):
    padded = table(spark, sf, "documents", "doc_id").select(
        F.concat(F.lit(" \t"), F.col("doc_id"), F.lit("\n")).alias("doc_id")
    )
    return overlap_count(padded, "doc_id", table(spark, sf, "labels", "doc_id"), "doc_id")


def name_join_left(spark, sf):
    customers = table(spark, sf, "customer", "c_custkey", "c_name")
    orders = table(spark, sf, "orders", "o_custkey", "o_totalprice")
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    named = orders.groupBy(name.alias("c_name")).agg(F.max("o_totalprice").alias("largest"))
    return name_join(customers, named, "c_name", "left").select("c_custkey", "c_name", "largest")


def first_seen_n(spark, sf):
    lines = table(spark, sf, "orders", "o_custkey", "o_orderkey")
    return first_seen(lines, "o_custkey", "o_orderkey", 100)


PART_LABELS = {"size": "Size of the part", "price": "Retail price of the part"}


def _wide_parts(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice").select(
        "p_partkey",
        F.nullif(size % 7, F.lit(0)).cast("double").alias("size"),
        (F.col("p_retailprice") - 1000).alias("price"),
    )


WIDE_PARTS_SQL = """
wide AS (SELECT p_partkey, CAST(nullif(p_size % 7, 0) AS DOUBLE) AS size,
  p_retailprice - 1000 AS price FROM part),
long AS (
  SELECT p_partkey, 'Size of the part' AS property, size AS value FROM wide
  UNION ALL SELECT p_partkey, 'Retail price of the part', price FROM wide)
"""


def melt_properties(spark, sf):
    return melt(_wide_parts(spark, sf), ["p_partkey"], PART_LABELS)


def melt_properties_nonnull(spark, sf):
    return melt(_wide_parts(spark, sf), ["p_partkey"], PART_LABELS, keep_null=False)


def encode_numbers(spark, sf):
    customers = table(spark, sf, "customer", "c_custkey", "c_acctbal")
    return customers.select("c_custkey", encode_number(F.col("c_acctbal") / 1000).alias("label"))


def decode_numbers(spark, sf):
    """Labels that lost as many leading letters as the nation key says."""
    label = encode_number(F.col("c_acctbal") / 1000)
    rows = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal").select(
        "c_custkey", F.substr(label, F.least(F.col("c_nationkey"), F.lit(9)) + 1).alias("label")
    )
    return rows.withColumn("number", decode_number(F.col("label")))


def training_text(spark, sf):
    parts = compounds(spark, sf)
    text = F.format_string(TRAINING_TEXT, "symbols", "property", "value")
    return parts.select("p_partkey", text.alias("text"))


def _measured(spark, sf):
    """Suppliers as measured entities."""
    return table(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal").select(
        F.col("s_suppkey").alias("pub_chem_cid"),
        F.col("s_name").alias("dsstox_substance_id"),
        F.col("s_acctbal").alias("mg"),
        F.nullif(F.col("s_nationkey"), F.lit(0)).cast("double").alias("ppm"),
    )


MEASURED_LABELS = {"mg": "balance (mg/L)", "ppm": "nation (ppm)"}


def _eav(spark, sf):
    """Parts as entity-property-value rows."""
    parts = table(spark, sf, "part", "p_partkey", "p_name", "p_brand").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("PUBCHEM_OPENEYE_CAN_SMILES"),
        F.col("p_brand").alias("BRAND"),
    )
    return parts.unpivot(["id"], ["PUBCHEM_OPENEYE_CAN_SMILES", "BRAND"], "property", "value")


def _bracketed(smiles):
    return F.concat(F.lit("["), F.regexp_replace(smiles, " ", "]["), F.lit("]"))


def union_of_parts(spark, sf):
    rows = _valued(spark, sf).select(
        "pub_chem_cid", F.col("heading").alias("property"), F.col("value_text").alias("value")
    )
    measured = melt(
        _measured(spark, sf), ["pub_chem_cid", "dsstox_substance_id"], MEASURED_LABELS, keep_null=False
    )
    return assemble_union(rows, measured)


def built_property_table(spark, sf):
    rows = property_table(
        annotations(spark, sf),
        _measured(spark, sf),
        _eav(spark, sf),
        keywords=["click", "purch", "sign"],
        endpoints=MEASURED_LABELS,
        to_symbols=_bracketed,
    )
    return rows.withColumn("symbols_split", F.array_join("symbols_split", "|"))


def vocab_from_json(spark, sf):
    """A vocabulary document per brand, specials among its symbols."""
    sizes = table(spark, sf, "part", "p_brand", "p_size").groupBy("p_brand").agg(F.max("p_size").alias("n"))
    text = F.concat(
        F.lit('{"symbol_to_index":{"<pad>":0,"<sos>":1,"<eos>":2,"['), "p_brand", F.lit(']":'), "n", F.lit("}}")
    )
    return vocabulary_of_json(sizes.select(text.alias("doc")), "doc")


QUERIES = {
    "annotation_value": annotation_value,
    "singleton_unwrap": singleton_unwrap,
    "property_label": labels,
    "keyword_literal": keyword_literal,
    "keyword_regex_two_col": keyword_regex_two_col,
    "keyword_word_bounded": keyword_word_bounded,
    "crosswalk_distinct": crosswalk_distinct,
    "crosswalk_left": crosswalk_left,
    "crosswalk_inner": crosswalk_inner,
    "semi_filter": semi_filter,
    "id_overlap": id_overlap,
    "name_join_left": name_join_left,
    "first_seen_n": first_seen_n,
    "melt_properties": melt_properties,
    "melt_properties_nonnull": melt_properties_nonnull,
    "encode_number": encode_numbers,
    "decode_number": decode_numbers,
    "training_text": training_text,
    "assemble_union": union_of_parts,
    "property_table": built_property_table,
    "vocab_from_json": vocab_from_json,
}

XWALK_SQL = f"""
single AS (SELECT * REPLACE (pub_chem_cid[1] AS pub_chem_cid) FROM valued WHERE len(pub_chem_cid) = 1),
xwalk AS (SELECT DISTINCT pub_chem_cid, value_text AS dsstox FROM single
          WHERE source_name = '{CROSSWALK_SOURCE}')
"""

UNION_SQL = """
melted AS (
  SELECT s_suppkey AS pub_chem_cid, s_name AS dsstox_substance_id, 'balance (mg/L)' AS property,
    s_acctbal AS value FROM supplier WHERE s_acctbal IS NOT NULL
  UNION ALL
  SELECT s_suppkey, s_name, 'nation (ppm)', CAST(s_nationkey AS DOUBLE) FROM supplier WHERE s_nationkey <> 0)
"""

ENCODE_SQL = """
CASE WHEN round({x}, 1) < 0 THEN 'negative ' ELSE 'positive ' END || CAST(abs(round({x}, 1)) AS VARCHAR)
"""

ORACLE = {
    "annotation_value": f"""
WITH {ANNOTATIONS_SQL}
SELECT event_id, value_text, TRY_CAST(value_text AS DOUBLE) AS value_num, NOT ok AS bad_record FROM valued
""",
    "singleton_unwrap": """
SELECT event_id, user_id AS pub_chem_cid, event_type AS heading FROM events
WHERE NOT (event_type = 'click' AND value > 50)
""",
    "property_label": f"""
WITH {ANNOTATIONS_SQL}
SELECT event_id, concat(source_name, ' - ', heading, ' - ', name) AS property FROM valued
""",
    "keyword_literal": f"SELECT doc_id, lang FROM documents WHERE {_literal('text', KEYWORDS)}",
    "keyword_regex_two_col": f"""
SELECT doc_id, source FROM documents
WHERE regexp_matches(lang || ' ' || source, '{"|".join(REGEX_KEYWORDS)}', 'i')
  AND regexp_matches(text, '{"|".join(REGEX_KEYWORDS)}', 'i')
""",
    "keyword_word_bounded": rf"""
SELECT doc_id, lang FROM documents
WHERE regexp_matches(text, '(^|[^\pL\pM\pN_])({"|".join(WORD_KEYWORDS)})($|[^\pL\pM\pN_])', 'i')
""",
    "crosswalk_distinct": f"WITH {ANNOTATIONS_SQL}, {XWALK_SQL} SELECT pub_chem_cid, dsstox FROM xwalk",
    "crosswalk_left": f"""
WITH {ANNOTATIONS_SQL}, {XWALK_SQL}
SELECT c_custkey AS pub_chem_cid, c_name, dsstox FROM customer LEFT JOIN xwalk ON c_custkey = pub_chem_cid
""",
    "crosswalk_inner": f"""
WITH {ANNOTATIONS_SQL}, {XWALK_SQL}
SELECT event_id, s.pub_chem_cid, heading, value_text, dsstox
FROM single s JOIN xwalk x ON s.pub_chem_cid = x.pub_chem_cid
""",
    "semi_filter": """
SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
""",
    "id_overlap": """
SELECT count(*) AS overlap FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
""",
    "name_join_left": """
SELECT c_custkey, c_name, largest FROM customer LEFT JOIN (
  SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name, max(o_totalprice) AS largest
  FROM orders GROUP BY 1) ON c_name = name
""",
    "first_seen_n": """
SELECT o_custkey, min(o_orderkey) AS first_seen FROM orders GROUP BY o_custkey
ORDER BY first_seen, o_custkey LIMIT 100
""",
    "melt_properties": f"WITH {WIDE_PARTS_SQL} SELECT p_partkey, property, value FROM long",
    "melt_properties_nonnull": f"""
WITH {WIDE_PARTS_SQL} SELECT p_partkey, property, value FROM long WHERE value IS NOT NULL
""",
    "encode_number": f"SELECT c_custkey, {ENCODE_SQL.format(x='c_acctbal / 1000')} AS label FROM customer",
    "decode_number": f"""
WITH labelled AS (
  SELECT c_custkey, substring({ENCODE_SQL.format(x='c_acctbal / 1000')}, least(c_nationkey, 9) + 1) AS label,
    least(c_nationkey, 9) AS lost, round(c_acctbal / 1000, 1) AS number FROM customer)
SELECT c_custkey, label,
  CASE WHEN lost >= 8 THEN abs(number) WHEN lost < 4 THEN number + 0.0 END AS number FROM labelled
""",
    "training_text": f"""
WITH {COMPOUNDS_SQL}
SELECT p_partkey, concat(symbols, ' <property> ', property, ' <value> ', value) AS text FROM comp
""",
    "assemble_union": f"""
WITH {ANNOTATIONS_SQL}, {XWALK_SQL}, {UNION_SQL}
SELECT pub_chem_cid, NULL AS dsstox_substance_id, heading AS property, value_text AS value FROM single
WHERE value_text IS NOT NULL
UNION ALL SELECT pub_chem_cid, dsstox_substance_id, property, CAST(value AS VARCHAR) FROM melted
""",
    "property_table": f"""
WITH {ANNOTATIONS_SQL}, {XWALK_SQL}, {UNION_SQL},
long AS (
  SELECT pub_chem_cid, NULL AS dsstox_substance_id,
    concat(source_name, ' - ', heading, ' - ', name) AS property, value_text AS value
  FROM single WHERE heading IN ('click', 'purchase', 'signup')
  UNION ALL SELECT pub_chem_cid, dsstox_substance_id, property, CAST(value AS VARCHAR) FROM melted)
SELECT pub_chem_cid, dsstox_substance_id, '[' || replace(p_name, ' ', '][') || ']' AS symbols,
  '[' || replace(p_name, ' ', ']|[') || ']' AS symbols_split, property, value
FROM long JOIN part ON pub_chem_cid = p_partkey WHERE value IS NOT NULL
""",
    "vocab_from_json": """
SELECT '[' || p_brand || ']' AS symbol, max(p_size) AS idx FROM part GROUP BY p_brand
""",
}
