"""Exemplars, capped context, digests and full prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from propflow.catalog.standin import MEASUREMENTS_SQL, measurements, table
from propflow.fixed_values import (
    CONTEXT_CAP,
    CONTEXT_SUFFIX,
    DECILES,
    DIGEST_HEAD,
    DIGEST_MIDDLE,
    DIGEST_TAIL,
    ESTIMATE_PROMPT,
    EXEMPLAR_HEADER,
    SUMMARY_PROMPT,
)
from propflow.operators import context, evaluate, exemplars
from propflow.operators.ordering import OrderStatistics
from propflow.plans.estimates import annotation_context, annotation_parts, whole_prompts
from propflow.session import scratch_path

KEYWORDS = ["the ", "src1.", "en ", "der|die", "les"]
PART_ROWS = 25
UNLABELLED = "unlabelled"


def _annotation_rows(spark, sf, how="inner"):
    """Labelled documents as lookup rows of four entities; a left join keeps the others as one more."""
    labels = table(spark, sf, "labels", "doc_id", "quality", "toxic").select(
        "doc_id", F.concat(F.lit("Q"), "quality", F.lit("T"), "toxic").alias("dsstox")
    )
    documents = table(spark, sf, "documents", "doc_id", "text", "lang", "source").select(
        "doc_id", F.concat_ws(" ", "lang", "source").alias("heading"), F.col("text").alias("value")
    )
    rows = documents.join(labels, "doc_id", how)
    return rows.withColumn("dsstox", F.coalesce("dsstox", F.lit(UNLABELLED))) if how == "left" else rows


def prompt_context(spark, sf):
    return annotation_context(_annotation_rows(spark, sf), "dsstox", ["doc_id"], KEYWORDS)


def prompt_context_whole(spark, sf):
    """All documents, labelled or not, and all of their text in ordered parts."""
    return annotation_parts(_annotation_rows(spark, sf, "left"), "dsstox", ["doc_id"], KEYWORDS)


def _digest(spark, sf):
    documents = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    return context.entity_digest(documents, "source", "lang", "text", "doc_id", PART_ROWS)


def digest_prompt(spark, sf):
    return context.digest_prompts(_digest(spark, sf), "source")


def _statistics(spark, sf):
    return OrderStatistics(measurements(spark, sf), "mg")


def quantile_edges(spark, sf):
    edges = exemplars.quantile_edges(measurements(spark, sf), "mg")
    rows = [(i, point, round(edge, 6)) for i, (point, edge) in enumerate(zip(DECILES, edges, strict=True))]
    return spark.createDataFrame(rows, "position int, point double, edge double")


def quantile_bin_members(spark, sf):
    rows = measurements(spark, sf)
    edges = exemplars.quantile_edges(rows, "mg")
    return exemplars.interval_members(rows, "mg", edges).select("bin", "o_orderkey")


def bin_medians(spark, sf):
    _, medians = _statistics(spark, sf).intervals(DECILES)
    rows = [(i, round(median, 6)) for i, median in enumerate(medians)]
    return spark.createDataFrame(rows, "bin int, median double")


def nearest_to_median(spark, sf):
    edges, medians = _statistics(spark, sf).intervals(DECILES)
    near = exemplars.nearest_to_median(measurements(spark, sf), "mg", "o_orderkey", edges, medians)
    return near.select("bin", "o_orderkey", "name")


def _exemplars(spark, sf):
    return exemplars.pick_exemplars(measurements(spark, sf), "mg", "o_orderkey")


def picked_exemplars(spark, sf):
    figures = [F.round(c, 6).alias(c) for c in ("mg", "ppm")]
    return _exemplars(spark, sf).select("kind", "o_orderkey", "name", *figures)


def exemplar_table(spark, sf):
    return context.exemplar_table(_exemplars(spark, sf), "name", "mg", "ppm", ["mg", "o_orderkey"])


def minmax_backtransform(spark, sf):
    bounds = evaluate.value_range(measurements(spark, sf), "mg")
    return bounds.select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def prompt_full(spark, sf):
    """The refining step stands for its model by trimming the summary prompt."""
    labels = table(spark, sf, "labels", "quality", "toxic").distinct()
    ids = labels.select(F.concat(F.lit("Q"), "quality", F.lit("T"), "toxic").alias("dsstox"))
    named = ids.withColumn("name", F.concat(F.lit("compound "), "dsstox"))
    details = context.attach_context(named, prompt_context(spark, sf), "dsstox")
    prompts = context.summary_prompts(details, "name")
    full = context.estimate_prompts(prompts, "name", exemplar_table(spark, sf), F.trim("prompt"))
    return full.select("dsstox", "full_prompt")


SHORT = 20_000


def shorten(prompt: str) -> str:
    """Stands for a refining model: the head of the prompt and its size; fails on some sizes."""
    size = len(prompt)
    if size % 13 == 0:
        raise ValueError(f"prompt of {size} characters")
    return f"{prompt[:SHORT]} ({size})"


def whole_entities(spark, sf):
    """(dsstox, name) of the labelled groups and of the documents without a label."""
    labels = table(spark, sf, "labels", "quality", "toxic").distinct()
    ids = labels.select(F.concat(F.lit("Q"), "quality", F.lit("T"), "toxic").alias("dsstox"))
    ids = ids.unionByName(spark.range(1).select(F.lit(UNLABELLED).alias("dsstox")))
    return ids.withColumn("name", F.concat(F.lit("compound "), "dsstox"))


def prompt_full_whole(spark, sf):
    """All documents, all of their text, brought down to one part per entity."""
    prompts = whole_prompts(
        whole_entities(spark, sf), _annotation_rows(spark, sf, "left"), KEYWORDS, ["doc_id"],
        exemplar_table(spark, sf), shorten, scratch_path(spark, "memo"), waves=2, digits=1,
    )
    return prompts.select("dsstox", "part", "full_prompt")


QUERIES = {
    "prompt_context": prompt_context,
    "prompt_context_whole": prompt_context_whole,
    "entity_digest": _digest,
    "digest_prompt": digest_prompt,
    "quantile_edges": quantile_edges,
    "quantile_bin_members": quantile_bin_members,
    "bin_medians": bin_medians,
    "nearest_to_median": nearest_to_median,
    "exemplars": picked_exemplars,
    "exemplar_table": exemplar_table,
    "minmax_backtransform": minmax_backtransform,
    "prompt_full": prompt_full,
    "prompt_full_whole": prompt_full_whole,
}


def _quoted(text: str) -> str:
    """Text as an SQL expression, control characters by code."""
    parts = text.replace("'", "''").replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'")
    return f"('{parts}')"


def _filled(template: str, *values: str) -> str:
    """A template with its `%n$s` (or single `%s`) places taken by SQL expressions."""
    sql = _quoted(template)
    for i, value in enumerate(values, 1):
        sql = sql.replace(f"%{i}$s", f"'||{value}||'")
    return sql.replace("%s", f"'||{values[0]}||'")


CONTEXT_SQL = f"""
rows AS (
  SELECT concat('Q', quality, 'T', toxic) AS dsstox, doc_id, concat(lang, ' ', source) AS heading, text AS value
  FROM documents JOIN labels USING (doc_id)),
kept AS (
  SELECT dsstox, string_agg(heading || ': ' || value, chr(10) ORDER BY doc_id) AS body FROM rows
  WHERE regexp_matches(heading, '{"|".join(KEYWORDS)}', 'i') AND regexp_matches(value, '{"|".join(KEYWORDS)}', 'i')
  GROUP BY dsstox),
ctx AS (
  SELECT dsstox, CASE WHEN length(body) > {CONTEXT_CAP}
    THEN substring(body, 1, {CONTEXT_CAP}) || '{CONTEXT_SUFFIX}' ELSE body END AS details
  FROM kept)
"""
WHOLE_SQL = f"""
rows AS (
  SELECT coalesce('Q' || quality || 'T' || toxic, '{UNLABELLED}') AS dsstox, doc_id,
    concat(lang, ' ', source) AS heading, text AS value
  FROM documents LEFT JOIN labels USING (doc_id)),
kept AS (
  SELECT dsstox, string_agg(heading || ': ' || value, chr(10) ORDER BY doc_id) AS body FROM rows
  WHERE regexp_matches(heading, '{"|".join(KEYWORDS)}', 'i') AND regexp_matches(value, '{"|".join(KEYWORDS)}', 'i')
  GROUP BY dsstox),
cuts AS (
  SELECT *, unnest(range(0, greatest(1, (length(body) + {CONTEXT_CAP} - 1) // {CONTEXT_CAP}))) AS p FROM kept)
"""

DIGEST_SQL = f"""
heads AS (SELECT source, lang AS text, 'headings' AS section, min(doc_id) AS ord FROM documents GROUP BY 1, 2),
pieces AS (
  SELECT * FROM heads UNION ALL SELECT source, text, 'details', doc_id FROM documents WHERE text IS NOT NULL),
placed AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY source, section ORDER BY ord) - 1) // {PART_ROWS} AS INTEGER)
    AS part FROM pieces),
digest AS (
  SELECT source, section, part,
    CASE section WHEN 'headings' THEN string_agg(text, ', ' ORDER BY ord)
      ELSE string_agg(text, ' ' ORDER BY ord) END AS text
  FROM placed GROUP BY source, section, part)
"""

BINS_SQL = f"""
{MEASUREMENTS_SQL},
q AS (SELECT quantile_cont(mg, {DECILES}) AS e FROM meas),
bins AS (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS bin FROM q),
members AS (SELECT bin, meas.* FROM meas, q, bins WHERE mg >= e[bin + 1] AND mg <= e[bin + 2]),
meds AS (SELECT bin, median(mg) AS med FROM members GROUP BY bin),
near AS (
  SELECT * FROM members JOIN meds USING (bin)
  QUALIFY row_number() OVER (PARTITION BY bin ORDER BY abs(mg - med), o_orderkey) <= 2)
"""

EXEMPLARS_SQL = f"""
{BINS_SQL},
lows AS (SELECT * FROM meas WHERE mg IS NOT NULL ORDER BY mg, o_orderkey LIMIT 1),
highs AS (SELECT * FROM meas WHERE mg IS NOT NULL ORDER BY mg DESC, o_orderkey LIMIT 1),
exem AS (
  SELECT 'min' AS kind, * FROM lows UNION ALL SELECT 'max', * FROM highs
  UNION ALL SELECT concat('bin', bin), o_orderkey, name, mg, ppm FROM near)
"""

TABLE_SQL = f"""
{EXEMPLARS_SQL},
ex_table AS (
  SELECT {_quoted(EXEMPLAR_HEADER)} || string_agg(name || chr(9) || printf('%.4f', round(pow(10, mg) * 1000, 4))
    || chr(9) || coalesce(printf('%.4f', round(pow(10, ppm), 4)), 'nan') || chr(10), '' ORDER BY mg, o_orderkey)
    AS examples_text FROM exem)
"""

_SUMMARY_SQL = "trim(" + _filled(SUMMARY_PROMPT, "concat('compound ', dsstox)", "coalesce(details, '')") + ")"

PROMPT_FULL_SQL = f"""
{CONTEXT_SQL}, {TABLE_SQL},
ids AS (SELECT DISTINCT concat('Q', quality, 'T', toxic) AS dsstox FROM labels),
full_prompts AS (
  SELECT dsstox, {_filled(ESTIMATE_PROMPT, "examples_text", _SUMMARY_SQL, "concat('compound ', dsstox)")}
    AS full_prompt
  FROM ids LEFT JOIN ctx USING (dsstox), ex_table)
"""

_REFINED_SQL = "CASE WHEN length({0}) % 13 <> 0 THEN trim(substring({0}, 1, " + str(SHORT) + ") || ' (' || length({0}) || ')') END"
_ROUNDS = 6


def _reduction_sql() -> str:
    """Rounds of refining over the parts `r0` (dsstox, p, t, done), the last one in `reduced`."""
    prompt = _filled(SUMMARY_PROMPT, "concat('compound ', dsstox)", "t")
    steps = []
    for i in range(1, _ROUNDS + 1):
        steps.append(f"""
c{i} AS (SELECT *, count(*) OVER (PARTITION BY dsstox) AS n FROM r{i - 1}),
s{i} AS (SELECT dsstox, p, n, t, {prompt} AS prompt FROM c{i} WHERE n > 1 AND NOT done),
j{i} AS (
  SELECT dsstox, max(n) AS n, string_agg(coalesce({_REFINED_SQL.format("prompt")}, t), chr(10) ORDER BY p) AS body
  FROM s{i} GROUP BY dsstox),
k{i} AS (SELECT *, greatest(1, (length(body) + {CONTEXT_CAP} - 1) // {CONTEXT_CAP}) AS m FROM j{i}),
u{i} AS (SELECT dsstox, body, unnest(range(0, m)) AS p FROM k{i} WHERE m < n),
r{i} AS (
  SELECT dsstox, p, substring(body, p * {CONTEXT_CAP} + 1, {CONTEXT_CAP}) AS t, false AS done FROM u{i}
  UNION ALL SELECT dsstox, p, t, true FROM c{i}
  WHERE n = 1 OR done OR dsstox IN (SELECT dsstox FROM k{i} WHERE m >= n))""")
    return ",".join(steps) + f",\nreduced AS (SELECT * FROM r{_ROUNDS})"


PROMPT_WHOLE_SQL = f"""
{WHOLE_SQL}, {TABLE_SQL},
r0 AS (
  SELECT dsstox, p, substring(body, p * {CONTEXT_CAP} + 1, {CONTEXT_CAP}) AS t, false AS done FROM cuts),
{_reduction_sql()},
ids AS (
  SELECT DISTINCT concat('Q', quality, 'T', toxic) AS dsstox FROM labels UNION ALL SELECT '{UNLABELLED}'),
asked AS (
  SELECT dsstox, coalesce(p, 0) AS p, {_filled(SUMMARY_PROMPT, "concat('compound ', dsstox)", "coalesce(t, '')")} AS prompt
  FROM ids LEFT JOIN reduced USING (dsstox)),
full_prompts AS (
  SELECT dsstox, CAST(p AS INTEGER) AS part,
    {_filled(ESTIMATE_PROMPT, "examples_text", "coalesce(" + _REFINED_SQL.format("prompt") + ", prompt)", "concat('compound ', dsstox)")}
    AS full_prompt
  FROM asked, ex_table)
"""

ORACLE = {
    "prompt_full_whole": f"WITH {PROMPT_WHOLE_SQL} SELECT dsstox, part, full_prompt FROM full_prompts",
    "prompt_context": f"WITH {CONTEXT_SQL} SELECT dsstox, details FROM ctx",
    "prompt_context_whole": f"""
WITH {WHOLE_SQL}
SELECT dsstox, CAST(p AS INTEGER) AS part, substring(body, p * {CONTEXT_CAP} + 1, {CONTEXT_CAP}) AS text FROM cuts
""",
    "entity_digest": f"WITH {DIGEST_SQL} SELECT source, section, part, text FROM digest",
    "digest_prompt": f"""
WITH {DIGEST_SQL}, ids AS (SELECT DISTINCT source FROM documents)
SELECT source, CASE section WHEN 'headings' THEN 1 ELSE 3 END AS step, part,
  CASE WHEN part = 0 THEN '' WHEN section = 'headings' THEN ', ' ELSE ' ' END || text AS text
FROM digest
UNION ALL SELECT source, 0, 0, {_filled(DIGEST_HEAD, "source")} FROM ids
UNION ALL SELECT source, 2, 0, {_quoted(DIGEST_MIDDLE)} FROM ids
UNION ALL SELECT source, 4, 0, {_quoted(DIGEST_TAIL)} FROM ids
""",
    "quantile_edges": f"""
WITH {MEASUREMENTS_SQL}, q AS (SELECT quantile_cont(mg, {DECILES}) AS e FROM meas)
SELECT CAST(i AS INTEGER) AS position, CAST({DECILES}[i + 1] AS DOUBLE) AS point, round(e[i + 1], 6) AS edge
FROM q, (SELECT unnest(range(0, 11)) AS i)
""",
    "quantile_bin_members": f"WITH {BINS_SQL} SELECT bin, o_orderkey FROM members",
    "bin_medians": f"WITH {BINS_SQL} SELECT bin, round(med, 6) AS median FROM meds",
    "nearest_to_median": f"WITH {BINS_SQL} SELECT bin, o_orderkey, name FROM near",
    "exemplars": f"""
WITH {EXEMPLARS_SQL} SELECT kind, o_orderkey, name, round(mg, 6) AS mg, round(ppm, 6) AS ppm FROM exem
""",
    "exemplar_table": f"WITH {TABLE_SQL} SELECT examples_text FROM ex_table",
    "minmax_backtransform": f"""
WITH {MEASUREMENTS_SQL}
SELECT round(pow(10, min(mg)), 4) AS low, round(pow(10, max(mg)), 4) AS high FROM meas
""",
    "prompt_full": f"WITH {PROMPT_FULL_SQL} SELECT dsstox, full_prompt FROM full_prompts",
}
