"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from propflow.llm import (
    collocations,
    decontaminate,
    language_id,
    mixing,
    negatives,
    ngram_join,
    perplexity,
    quality_rules,
    sharding,
    suffix_dedup,
    surrogates,
    token_counts,
    toxicity,
)


def _documents(spark, sf, *columns):
    return spark.read.parquet(f"{sf}/documents.parquet").select(*columns)


def op1_line_rules(spark, sf):
    return quality_rules.quality_report(_documents(spark, sf, "doc_id", "text"), "doc_id")


def op2_qgram_lemma(spark, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    return decontaminate.leaks(_documents(spark, sf, "doc_id", "text"), benchmark)


def op3_surrogates(spark, sf):
    return surrogates.replace_entities(_documents(spark, sf, "doc_id", "text"))


def op4_length_histogram(spark, sf):
    return token_counts.length_report(token_counts.length_histogram(_documents(spark, sf, "text")))


def op5_ngram_join(spark, sf):
    return ngram_join.shingle_components(_documents(spark, sf, "doc_id", "text"))


def op6_hash_tree(spark, sf):
    docs = _documents(spark, sf, "doc_id", "text")
    return sharding.shard_slots(docs, sharding.layout(16), sharding.layout(17))


def op7_difference_cover(spark, sf):
    return suffix_dedup.removal_report(_documents(spark, sf, "doc_id", "text"))


def op8_kneser_ney(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return perplexity.quality_report(_documents(spark, sf, "doc_id", "text", "lang"), labels)


def op9_entropy_balance(spark, sf):
    return mixing.mix_report(_documents(spark, sf, "doc_id", "text", "source"))


def op10_weak_supervision(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return toxicity.toxicity_report(_documents(spark, sf, "doc_id", "text", "lang"), labels)


def _digest_vectors(spark, sf):
    """The embeddings in whole numbers, every seventh under its next label; rows that lack anything are left out."""
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) <> double('infinity'))"
    return spark.read.parquet(f"{sf}/embeddings.parquet").where(f"label is not null and embedding is not null and {finite}").selectExpr(
        "vec_id AS id", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label",
        "transform(embedding, x -> floor(256 * cast(x as double))) AS v",
    )


def op11_anchor_lists(spark, sf):
    vectors = _digest_vectors(spark, sf)
    return negatives.hard_negatives(vectors, vectors.where("id % 100 = 0"))


def op12_son_collocations(spark, sf):
    return collocations.collocations(_documents(spark, sf, "doc_id", "text", "lang"))


def op13_kneser_ney_languages(spark, sf):
    return language_id.predict_languages(_documents(spark, sf, "doc_id", "text", "lang"))


QUERIES = {
    "op1_line_rules": op1_line_rules,
    "op2_qgram_lemma": op2_qgram_lemma,
    "op3_surrogates": op3_surrogates,
    "op4_length_histogram": op4_length_histogram,
    "op5_ngram_join": op5_ngram_join,
    "op6_hash_tree": op6_hash_tree,
    "op7_difference_cover": op7_difference_cover,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_entropy_balance": op9_entropy_balance,
    "op10_weak_supervision": op10_weak_supervision,
    "op11_anchor_lists": op11_anchor_lists,
    "op12_son_collocations": op12_son_collocations,
    "op13_kneser_ney_languages": op13_kneser_ney_languages,
}

NEGATIVES_SQL = """
WITH vectors AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor, r.id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors r ON a.id <> r.id WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor, id AS positive, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor AS anchor_id, p.positive AS positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
    s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same
    AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM ranked WHERE rank <= 5
"""

ORACLE = {
    "op1_line_rules": quality_rules.quality_sql(),
    "op11_anchor_lists": NEGATIVES_SQL,
    "op12_son_collocations": collocations.collocations_sql(),
}
