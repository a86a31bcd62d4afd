"""Symbols, vocabularies, packed sequences, lookup, split and category scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from propflow.catalog.standin import COMPOUNDS_SQL, compounds, table
from propflow.functions.symbols import pack_sequence, split_symbols
from propflow.operators import lookup, scoring, tokens
from propflow.operators.split import split_exact as split_rows
from propflow.plans import sequences

SPECIALS = ["<pad>", "<unk>"]


def _text(tokens_column: str) -> Column:
    return F.array_join(F.col(tokens_column).cast("array<string>"), ",")


def split(spark, sf):
    symbols = split_symbols(F.col("symbols"))
    return compounds(spark, sf).select(
        "p_partkey", F.array_join(symbols, "|").alias("symbols"), F.size(symbols).alias("n")
    )


def _vocabulary(spark, sf):
    """Symbols of the part names; brands stay unknown."""
    names = F.concat(F.lit("["), F.regexp_replace("p_name", " ", "]["), F.lit("]."))
    parts = table(spark, sf, "part", "p_name")
    return tokens.fit_vocabulary(parts, split_symbols(names), SPECIALS)


def vocab_extend(spark, sf):
    brands = compounds(spark, sf).select(F.explode(split_symbols(F.col("symbols"))).alias("symbol"))
    return tokens.extend_vocabulary(_vocabulary(spark, sf), brands)


def _split_compounds(spark, sf):
    return compounds(spark, sf).withColumn("parts", split_symbols(F.col("symbols")))


def vocab_encode(spark, sf):
    coded = tokens.encode_columns(
        _split_compounds(spark, sf), {"parts": "ids"}, _vocabulary(spark, sf), unknown=1
    )
    return coded.select("p_partkey", _text("ids").alias("ids"))


def vocab_encode_pad(spark, sf):
    coded = tokens.encode_padded(
        _split_compounds(spark, sf), "parts", _vocabulary(spark, sf), "ids",
        length=120, pad=0, unknown=1,
    )
    return coded.select("p_partkey", _text("ids").alias("ids"), F.size("ids").alias("n"))


def _stored(spark, sf):
    return _split_compounds(spark, sf).select(
        "p_partkey",
        F.transform("parts", F.length).alias("tokens"),
        F.array(F.length("property")).alias("prop"),
        F.array(F.length("value")).alias("value"),
        "property",
    )


def packed(spark, sf):
    """Token ids are symbol lengths here; a SMALL part has no value tokens."""
    value = F.when(F.col("property") != "SMALL", F.col("value"))
    tensor = pack_sequence(F.col("tokens"), F.col("prop"), value, 101, 102, 103)
    return _stored(spark, sf).withColumn("tensor", tensor).select("p_partkey", _text("tensor").alias("tensor"))


def pad_to_max(spark, sf):
    documents = table(spark, sf, "documents", "doc_id", "text")
    lengths = F.transform(F.split("text", "\n"), lambda line: F.length(line))
    padded = tokens.pad_to_longest(documents.select("doc_id", lengths.alias("tokens")), "tokens", "ids")
    return padded.select("doc_id", F.size("ids").alias("n"), F.md5(_text("ids")).alias("ids_md5"))


def sorted_index(spark, sf):
    return lookup.sorted_index(_stored(spark, sf), "tokens", "p_partkey").select("place", "p_partkey")


def sequence_lookup(spark, sf):
    """Every part asks for its own sequence, one in some sizes with a token nobody has."""
    asked = _split_compounds(spark, sf).join(table(spark, sf, "part", "p_partkey", "p_size"), "p_partkey")
    odd = F.when(F.col("p_size") > 40, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    queries = asked.select(
        F.col("p_partkey").alias("query"), F.concat(F.transform("parts", F.length), odd).alias("tokens")
    )
    found = lookup.lookup_sequences(queries, _stored(spark, sf), "tokens", "p_partkey", ["prop", "value"])
    first = [F.get(name, F.lit(0)).alias(name) for name in ("prop", "value")]
    return found.select("query", "p_partkey", *first)


def split_exact(spark, sf):
    return split_rows(table(spark, sf, "part", "p_partkey"), "p_partkey")


def training_sequences(spark, sf):
    rows = compounds(spark, sf)
    vocabulary = sequences.build_vocabulary(rows, "symbols", "property", "value")
    coded = sequences.tokenised(rows, "p_partkey", "symbols", "property", "value", vocabulary)
    return sequences.training_rows(coded, "p_partkey").select(
        "p_partkey", _text("input_ids").alias("input_ids"), _text("labels").alias("labels"), "split"
    )


def _scores(spark, sf, **options):
    """Embeddings as logits; two candidate categories of two tokens, one of them padded."""
    label = F.col("label")
    candidates = F.array(
        F.struct(F.lit("near").alias("category"), F.array(label, label + 10).alias("ids")),
        F.struct(F.lit("far").alias("category"), F.array(label + 20, F.lit(None).cast("int")).alias("ids")),
    )
    rows = table(spark, sf, "embeddings", "vec_id", "embedding", "label").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("logits")
    )
    return scoring.candidate_scores(rows, "vec_id", candidates, **options)


def categorical_logprob(spark, sf):
    return _scores(spark, sf).select("vec_id", "category", F.round("logprob", 6).alias("logprob"))


def categorical_argmax(spark, sf):
    best = scoring.best_category(_scores(spark, sf, length_normalised=True), "vec_id", "category")
    return best.select("vec_id", "category", F.round("logprob", 6).alias("logprob"))


QUERIES = {
    "split_symbols": split,
    "vocab_fit": _vocabulary,
    "vocab_extend": vocab_extend,
    "vocab_encode": vocab_encode,
    "vocab_encode_pad": vocab_encode_pad,
    "pack_sequence": packed,
    "pad_to_max": pad_to_max,
    "sorted_index": sorted_index,
    "sequence_lookup": sequence_lookup,
    "split_exact": split_exact,
    "training_sequences": training_sequences,
    "categorical_logprob": categorical_logprob,
    "categorical_argmax": categorical_argmax,
}

SPLIT_SQL = f"""
{COMPOUNDS_SQL},
parts AS (SELECT *, regexp_extract_all(symbols, '\\[[^\\]]*\\]|\\.') AS parts FROM comp)
"""

VOCAB_SQL = f"""
{SPLIT_SQL},
names AS (SELECT DISTINCT unnest(regexp_extract_all(concat('[', replace(p_name, ' ', ']['), '].'),
  '\\[[^\\]]*\\]|\\.')) AS symbol FROM part),
vocab AS (
  SELECT '<pad>' AS symbol, 0 AS idx UNION ALL SELECT '<unk>', 1
  UNION ALL SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) + 1 AS INTEGER) FROM names)
"""

CODED_SQL = f"""
{VOCAB_SQL},
exploded AS (SELECT p_partkey, unnest(parts) AS symbol, generate_subscripts(parts, 1) AS pos FROM parts),
coded AS (
  SELECT p_partkey, string_agg(CAST(coalesce(idx, 1) AS VARCHAR), ',' ORDER BY pos) AS ids, count(*) AS n
  FROM exploded LEFT JOIN vocab USING (symbol) GROUP BY p_partkey)
"""

STORED_SQL = f"""
{SPLIT_SQL},
stored AS (SELECT p_partkey, list_transform(parts, lambda s: length(s)) AS tokens,
  length(property) AS prop, length(value) AS value, property FROM parts)
"""

WORDS_SQL = f"""
{SPLIT_SQL},
specials AS (SELECT * FROM (VALUES ('<pad>', 0), ('<unk>', 1), ('<sos>', 2), ('<property>', 3), ('<value>', 4))
  AS t(symbol, idx)),
bracketed AS (SELECT symbol, 4 + row_number() OVER (ORDER BY symbol) AS idx
  FROM (SELECT DISTINCT unnest(parts) AS symbol FROM parts)),
worded AS (SELECT symbol, (SELECT max(idx) FROM bracketed) + row_number() OVER (ORDER BY symbol) AS idx
  FROM (SELECT DISTINCT lower(property) AS symbol FROM comp UNION SELECT lower(value) FROM comp)),
vocab AS (SELECT * FROM specials UNION ALL SELECT * FROM bracketed UNION ALL SELECT * FROM worded),
pieces AS (
  SELECT p_partkey, 0 AS step, 0 AS pos, '<sos>' AS symbol FROM comp
  UNION ALL SELECT p_partkey, 1, generate_subscripts(parts, 1), unnest(parts) FROM parts
  UNION ALL SELECT p_partkey, 2, 0, '<property>' FROM comp
  UNION ALL SELECT p_partkey, 3, 0, lower(property) FROM comp
  UNION ALL SELECT p_partkey, 4, 0, '<value>' FROM comp
  UNION ALL SELECT p_partkey, 5, 0, lower(value) FROM comp),
joined AS (
  SELECT p_partkey, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY step, pos) AS ids, count(*) AS n
  FROM pieces JOIN vocab USING (symbol) GROUP BY p_partkey),
padded AS (SELECT p_partkey, ids || repeat(',0', (SELECT max(n) FROM joined) - n) AS ids FROM joined)
"""

CUT_SQL = """
hashed AS (SELECT p_partkey, md5('42|' || CAST(p_partkey AS VARCHAR)) AS h FROM part),
cut AS (SELECT max(h) AS h FROM (SELECT h FROM hashed ORDER BY h
  LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM part))),
split AS (SELECT p_partkey, CASE WHEN hashed.h <= cut.h THEN 'test' ELSE 'train' END AS split FROM hashed, cut)
"""

LOGITS_SQL = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
lse AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) AS z FROM v),
near AS (SELECT vec_id, 'near' AS category, (x[label + 1] - z) + (x[label + 11] - z) AS logprob, 2 AS n FROM lse),
far AS (SELECT vec_id, 'far' AS category, x[label + 21] - z AS logprob, 1 AS n FROM lse),
scores AS (SELECT * FROM near UNION ALL SELECT * FROM far)
"""

ORACLE = {
    "split_symbols": f"""
WITH {SPLIT_SQL}
SELECT p_partkey, array_to_string(parts, '|') AS symbols, CAST(len(parts) AS INTEGER) AS n FROM parts
""",
    "vocab_fit": f"WITH {VOCAB_SQL} SELECT symbol, idx FROM vocab",
    "vocab_extend": f"""
WITH {VOCAB_SQL},
fresh AS (SELECT DISTINCT unnest(parts) AS symbol FROM parts)
SELECT symbol, idx FROM vocab
UNION ALL
SELECT symbol, CAST((SELECT max(idx) FROM vocab) + row_number() OVER (ORDER BY symbol) AS INTEGER)
FROM fresh WHERE symbol NOT IN (SELECT symbol FROM vocab)
""",
    "vocab_encode": f"WITH {CODED_SQL} SELECT p_partkey, ids FROM coded",
    "vocab_encode_pad": f"""
WITH {CODED_SQL} SELECT p_partkey, ids || repeat(',0', 120 - n) AS ids, 120 AS n FROM coded
""",
    "pack_sequence": f"""
WITH {STORED_SQL}
SELECT p_partkey, CASE WHEN property <> 'SMALL' THEN
  concat('101,', array_to_string(tokens, ','), ',102,', prop, ',103,', value) END AS tensor
FROM stored
""",
    "pad_to_max": """
WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: length(l)) AS x FROM documents),
m AS (SELECT max(len(x)) AS m FROM t)
SELECT doc_id, CAST(m AS INTEGER) AS n, md5(array_to_string(x, ',') || repeat(',0', m - len(x))) AS ids_md5
FROM t, m
""",
    "sorted_index": f"""
WITH {STORED_SQL} SELECT row_number() OVER (ORDER BY tokens, p_partkey) - 1 AS place, p_partkey FROM stored
""",
    "sequence_lookup": f"""
WITH {STORED_SQL},
firsts AS (SELECT tokens, min(p_partkey) AS p_partkey FROM stored GROUP BY tokens),
queries AS (SELECT s.p_partkey AS query, tokens FROM stored s JOIN part p ON s.p_partkey = p.p_partkey
  WHERE p_size <= 40)
SELECT part.p_partkey AS query, f.p_partkey, CAST(s.prop AS INTEGER) AS prop, CAST(s.value AS INTEGER) AS value
FROM part LEFT JOIN queries q ON part.p_partkey = q.query
LEFT JOIN firsts f ON q.tokens = f.tokens LEFT JOIN stored s ON f.p_partkey = s.p_partkey
""",
    "split_exact": f"WITH {CUT_SQL} SELECT p_partkey, split FROM split",
    "training_sequences": f"""
WITH {WORDS_SQL}, {CUT_SQL}
SELECT p_partkey, ids AS input_ids, ids AS labels, split FROM padded JOIN split USING (p_partkey)
""",
    "categorical_logprob": f"""
WITH {LOGITS_SQL} SELECT vec_id, category, round(logprob, 6) AS logprob FROM scores
""",
    "categorical_argmax": f"""
WITH {LOGITS_SQL}
SELECT vec_id, arg_max(category, logprob / n) AS category, round(max(logprob / n), 6) AS logprob
FROM scores GROUP BY vec_id
""",
}
