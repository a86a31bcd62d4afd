"""Joins and lookups that go by an index: keyword lists, intervals, two keys, stored sequences, grouped quantiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from propflow.catalog.sequences import STORED_SQL, _split_compounds, _stored
from propflow.catalog.standin import table
from propflow.operators import keyword_join, quantiles
from propflow.operators.lookup import StoredIndex
from propflow.operators.range_join import range_join
from propflow.session import scratch_path
from propflow.sources.indexed import IndexedTable
from propflow.sources.sinks import save_bucketed, write_split_sheet
from propflow.sources.tables import read_split_sheet

LETTERS = "[a-z]{5,}"


def _keywords(spark, sf):
    """The distinct words of the part names and of the pages."""
    names = table(spark, sf, "part", "p_name").select(F.explode(F.split("p_name", " ")).alias("keyword"))
    words = F.regexp_extract_all(F.lower("html"), F.lit(LETTERS), F.lit(0))
    pages = table(spark, sf, "pages", "html").select(F.explode(words).alias("keyword"))
    return names.unionByName(pages).distinct()


def keyword_index(spark, sf):
    """How many of some thousand keywords each turn of a conversation holds."""
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text")
    found = keyword_join.with_keywords(turns, "text", _keywords(spark, sf))
    return found.select("conv_id", "turn", "n_keywords", "first_keyword")


def keyword_index_word(spark, sf):
    """Documents whose source and text both hold one of the keywords as a word."""
    documents = table(spark, sf, "documents", "doc_id", "source", "text")
    tagged = documents.withColumn("heading", F.concat_ws(" ", F.col("source"), F.element_at(F.split("text", " "), 1)))
    kept = keyword_join.rows_with_keywords(tagged, ["heading", "text"], _keywords(spark, sf), mode="word")
    return kept.select("doc_id", "source")


def interval_join(spark, sf):
    """Line items by price within one interval per part, a third of the parts with a wide one."""
    parts = table(spark, sf, "part", "p_partkey", "p_retailprice", "p_size")
    low = F.col("p_retailprice") * 20 + F.col("p_partkey") % 977
    width = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 40).otherwise(F.col("p_size"))
    intervals = parts.select("p_partkey", low.alias("low"), (low + width).alias("high"))
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice", "l_quantity")
    totals = {"n": ("count", "*"), "orders": ("sum", "l_orderkey"), "most": ("max", "l_extendedprice")}
    met = range_join(lines, "l_extendedprice", intervals, "low", "high", totals=totals)  # the pairs are some hundred to a part
    return met.groupBy("p_partkey").agg(F.sum("n").alias("n"), F.sum("orders").alias("orders"), F.max("most").alias("most"))


def group_quartiles(spark, sf):
    """Quartiles of price and quantity per supplier, a third of the lines under one of them."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity")
    hot = F.when(F.col("l_orderkey") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("l_suppkey"))
    found = quantiles.grouped_quantiles(lines.withColumn("l_suppkey", hot), ["l_suppkey"], ["l_extendedprice", "l_quantity"])
    return found.withColumn("value", F.round("value", 6))


def two_key_lookup(spark, sf):
    """Line items stored once, then asked by part and by order."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    stored = IndexedTable(spark, scratch_path(spark, "indexed"), "l_partkey", "l_orderkey").write(lines, ["l_orderkey"])
    by_key = stored.by_key([3, 14, 159]).withColumn("asked", F.lit("part"))
    return by_key.unionByName(stored.by_second([1, 41, 1000]).withColumn("asked", F.lit("order")))


def bucketed_join(spark, sf):
    """Orders and their lines in tables bucketed alike, joined without moving either."""
    names = [f"propflow_{uuid.uuid4().hex}" for _ in range(2)]
    save_bucketed(table(spark, sf, "orders", "o_orderkey", "o_custkey"), names[0], "o_orderkey", 8)
    save_bucketed(table(spark, sf, "lineitem", "l_orderkey", "l_quantity"), names[1], "l_orderkey", 8)
    orders, lines = (spark.table(name) for name in names)
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return joined.groupBy("o_orderkey", "o_custkey").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count(F.lit(1)).alias("n"))


def stored_lookup(spark, sf):
    """Two lookups against one stored index: all parts' sequences, then a few of them."""
    stored = StoredIndex(spark, scratch_path(spark, "index"), "tokens", "p_partkey", ["prop", "value"])
    stored.write(_stored(spark, sf), files=4)
    odd = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    queries = _split_compounds(spark, sf).select(
        F.col("p_partkey").alias("query"), F.concat(F.transform("parts", F.length), odd).alias("tokens")
    )
    every, few = stored.lookup(queries), stored.lookup(queries.where("query < 20"))
    both = every.withColumn("asked", F.lit("all")).unionByName(few.withColumn("asked", F.lit("few")))
    first = [F.get(name, F.lit(0)).alias(name) for name in ("prop", "value")]
    return both.select("asked", "query", "p_partkey", *first)


def csv_split_roundtrip(spark, sf):
    """Whole documents through a sheet that many tasks can read."""
    documents = table(spark, sf, "documents", "doc_id", "lang", "text")
    path = write_split_sheet(documents, scratch_path(spark, "sheet"), ["doc_id", "text", "lang"])
    return read_split_sheet(spark, path, "doc_id bigint, text string, lang string")


QUERIES = {
    "keyword_index": keyword_index,
    "keyword_index_word": keyword_index_word,
    "interval_join": interval_join,
    "group_quartiles": group_quartiles,
    "two_key_lookup": two_key_lookup,
    "bucketed_join": bucketed_join,
    "stored_lookup": stored_lookup,
    "csv_split_roundtrip": csv_split_roundtrip,
}

KEYWORDS_SQL = f"""
keywords AS (
  SELECT DISTINCT unnest(string_split(p_name, ' ')) AS keyword FROM part
  UNION SELECT DISTINCT unnest(regexp_extract_all(lower(html), '{LETTERS}')) FROM pages)
"""

ORACLE = {
    "keyword_index": f"""
WITH {KEYWORDS_SQL}
SELECT conv_id, turn, count(keyword) AS n_keywords, min(keyword) AS first_keyword
FROM conversations LEFT JOIN keywords ON contains(lower(text), keyword) GROUP BY conv_id, turn
""",
    # a keyword of letters is a word of the text where no word character stands beside it
    "keyword_index_word": f"""
WITH {KEYWORDS_SQL},
tagged AS (SELECT doc_id, source, lower(concat_ws(' ', source, string_split(text, ' ')[1])) AS heading, lower(text) AS text FROM documents),
words AS (
  SELECT doc_id, source, regexp_extract_all(heading, '[\\pL\\pN\\pM_]+') AS h, regexp_extract_all(text, '[\\pL\\pN\\pM_]+') AS t FROM tagged),
heads AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(h) AS keyword FROM words) JOIN keywords USING (keyword)),
texts AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(t) AS keyword FROM words) JOIN keywords USING (keyword))
SELECT doc_id, source FROM documents JOIN heads USING (doc_id) JOIN texts USING (doc_id)
""",
    "interval_join": """
WITH base AS (
  SELECT p_partkey, p_retailprice * 20 + p_partkey % 977 AS low,
    CASE WHEN p_partkey % 3 = 0 THEN p_size * 40 ELSE p_size END AS width FROM part),
intervals AS (SELECT p_partkey, low, low + width AS high FROM base)
SELECT p_partkey, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders, max(l_extendedprice) AS most
FROM intervals JOIN lineitem ON l_extendedprice >= low AND l_extendedprice <= high GROUP BY p_partkey
""",
    "group_quartiles": """
WITH lines AS (
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS l_suppkey, l_extendedprice, l_quantity FROM lineitem),
long AS (
  SELECT l_suppkey, 'l_extendedprice' AS "column", CAST(l_extendedprice AS DOUBLE) AS x FROM lines
  UNION ALL SELECT l_suppkey, 'l_quantity', CAST(l_quantity AS DOUBLE) FROM lines),
cuts AS (
  SELECT l_suppkey, "column", count(x) AS n, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM long WHERE x IS NOT NULL GROUP BY ALL)
SELECT l_suppkey, "column", n, CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS point, round(unnest(q), 6) AS value FROM cuts
""",
    "two_key_lookup": """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, 'part' AS asked FROM lineitem WHERE l_partkey IN (3, 14, 159)
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, 'order' FROM lineitem WHERE l_orderkey IN (1, 41, 1000)
""",
    "bucketed_join": """
SELECT o_orderkey, o_custkey, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey
""",
    "stored_lookup": f"""
WITH {STORED_SQL},
firsts AS (SELECT tokens, min(p_partkey) AS p_partkey FROM stored GROUP BY tokens),
answers AS (
  SELECT q.p_partkey AS query, f.p_partkey, CAST(s.prop AS INTEGER) AS prop, CAST(s.value AS INTEGER) AS value
  FROM stored q LEFT JOIN firsts f ON q.tokens = f.tokens AND q.p_partkey % 5 <> 0
  LEFT JOIN stored s ON f.p_partkey = s.p_partkey)
SELECT 'all' AS asked, * FROM answers UNION ALL SELECT 'few', * FROM answers WHERE query < 20
""",
    "csv_split_roundtrip": "SELECT doc_id, text, lang FROM documents",
}
