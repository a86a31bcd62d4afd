"""Memoised batch inference with a deterministic stand-in for the model."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from propflow.catalog.context import KEYWORDS, PROMPT_FULL_SQL, PROMPT_WHOLE_SQL, _annotation_rows, shorten, whole_entities
from propflow.catalog.standin import measurements, table
from propflow.functions.responses import memo_key, parse_response
from propflow.operators import evaluate, inference
from propflow.operators.memo import Memo
from propflow.plans.estimates import estimate_entities, estimate_whole, question_estimates
from propflow.session import scratch_path


def answer(prompt: str) -> str:
    """JSON from the length of the prompt; fails on some prompts, answers others badly."""
    size = len(prompt)
    if size % 11 == 0:
        raise ValueError(f"prompt of {size} characters")
    if size % 7 == 0:
        return f"no estimate for {size}"
    units = "ppm" if size % 2 else "mg"
    return json.dumps({"chemical_name": f"c{size}", "units": units, "lc50": size - 100, "confidence": size % 10})


ANSWER_SQL = """
CASE WHEN length(text) % 11 = 0 THEN NULL
  WHEN length(text) % 7 = 0 THEN concat('no estimate for ', length(text))
  ELSE concat('{"chemical_name": "c', length(text), '", "units": "',
    CASE WHEN length(text) % 2 = 1 THEN 'ppm' ELSE 'mg' END, '", "lc50": ', length(text) - 100,
    ', "confidence": ', length(text) % 10, '}') END
"""


def _requests(spark, sf):
    """All turns as prompts."""
    turns = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return turns.withColumn("memo_key", memo_key("answer", "1", "text"))


def _memo(spark, sf):
    """The memo of an earlier run that had seen the opening turns."""
    opening = _requests(spark, sf).where("turn = 0")
    return opening.select("memo_key", F.concat(F.lit("stored for "), F.length("text")).alias("result"))


def memo_misses(spark, sf):
    return inference.memo_misses(_requests(spark, sf), _memo(spark, sf), ["text"])


def batch_infer(spark, sf):
    asked = _requests(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("request"), "text")
    return inference.infer(asked, "request", ["text"], answer)


def memo_merge(spark, sf):
    misses = inference.memo_misses(_requests(spark, sf), _memo(spark, sf), ["text"])
    fresh = inference.infer(misses, "memo_key", ["text"], answer)
    merged = inference.merge_memo(_requests(spark, sf), _memo(spark, sf), fresh)
    return merged.select("conv_id", "turn", "result", "memo_hit")


def responses(spark, sf):
    parsed = batch_infer(spark, sf).withColumn("answer", parse_response(F.col("result")))
    return parsed.select("request", "answer.chemical_name", "answer.units", "answer.lc50", "answer.confidence")


def prediction_record(spark, sf):
    lines = table(
        spark, sf, "lineitem",
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    )
    estimates = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_partkey").cast("string").alias("name"),
        (F.col("l_extendedprice") - 30000).alias("mg"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity") - 10).alias("ppm"),
        F.col("l_linenumber").alias("conf_mg"),
        F.nullif(F.col("l_linenumber"), F.lit(3)).alias("conf_ppm"),
    )
    records = evaluate.prediction_records(estimates, "id", "name", "mg", "ppm", "conf_mg", "conf_ppm")
    figures = {c: F.round(c, 6) for c in ("pred_lc50_4hr_mg_L", "pred_lc50_4hr_ppm")}
    return records.withColumns(figures)


def user_codec_hook(spark, sf):
    """A Python codec that reverses a name and rejects bolts."""

    def codec(name: str) -> str:
        if "bolt" in name:
            raise ValueError(name)
        return name[::-1]

    parts = table(spark, sf, "part", "p_partkey", "p_name")
    return inference.apply_codec(parts, "p_name", codec, "coded", "string")


def codec_once(spark, sf):
    """A Python codec asked once per segment, whatever number of customers is in it."""

    def codec(segment: str) -> str:
        if segment.startswith("A"):
            raise ValueError(segment)
        return segment.lower()

    customers = table(spark, sf, "customer", "c_custkey", "c_mktsegment")
    return inference.apply_codec_once(customers, "c_mktsegment", codec, "coded", "string")


def estimate_table(spark, sf):
    """Four entities asked for two endpoints with context, exemplars and a refined summary."""

    def model(prompt: str, endpoint: str) -> str:
        return json.dumps({"lc50": len(prompt) - len(endpoint), "confidence": len(prompt) % 10})

    labels = table(spark, sf, "labels", "quality", "toxic").distinct()
    ids = labels.select(F.concat(F.lit("Q"), "quality", F.lit("T"), "toxic").alias("dsstox"))
    records = estimate_entities(
        ids.withColumn("name", F.concat(F.lit("compound "), "dsstox")),
        _annotation_rows(spark, sf),
        measurements(spark, sf),
        KEYWORDS,
        ["doc_id"],
        refine=str.strip,
        model=model,
        memo_path=scratch_path(spark, "memo"),
        measured_id="o_orderkey",
    )
    figures = {c: F.round(c, 6) for c in ("pred_lc50_4hr_mg_L", "pred_lc50_4hr_ppm")}
    return records.withColumns(figures)


def estimate_table_whole(spark, sf):
    """The same over all documents, labelled or not, and all of their text."""

    def model(prompt: str, endpoint: str) -> str:
        return json.dumps({"lc50": len(prompt) - len(endpoint), "confidence": len(prompt) % 10})

    records = estimate_whole(
        whole_entities(spark, sf),
        _annotation_rows(spark, sf, "left"),
        measurements(spark, sf),
        KEYWORDS,
        ["doc_id"],
        refine=shorten,
        model=model,
        memo_path=scratch_path(spark, "memo"),
        measured_id="o_orderkey",
        waves=2,
        digits=1,
    )
    figures = {c: F.round(c, 6) for c in ("pred_lc50_4hr_mg_L", "pred_lc50_4hr_ppm")}
    return records.withColumns(figures)


def infer_waves(spark, sf):
    """All turns asked in waves over a memo that already holds the opening ones."""
    path = scratch_path(spark, "memo")
    Memo(spark, path, digits=1).commit(_memo(spark, sf).distinct().withColumn("error", F.lit(None).cast("string")))
    answers = inference.ask_in_waves(_requests(spark, sf), ["text"], answer, path, waves=4, digits=1)
    return answers.select("conv_id", "turn", "result", "error", "memo_hit")


def memo_generations(spark, sf):
    """Two generations, the second repeating keys and failing on some, a compaction, and one more generation."""
    memo = Memo(spark, scratch_path(spark, "memo"), digits=1)
    keys = _requests(spark, sf).groupBy("memo_key").agg(F.max(F.length("text")).alias("size"))
    keys = keys.withColumn("error", F.lit(None).cast("string"))
    memo.commit(keys.where("size % 2 = 0").withColumn("result", F.concat(F.lit("first "), "size")))
    second = keys.where("size % 3 = 0")
    failed = F.when(F.col("size") % 5 == 0, F.concat(F.lit("failed "), "size"))
    memo.commit(second.withColumns({"error": failed, "result": F.when(failed.isNull(), F.concat(F.lit("second "), "size"))}))
    memo.compact()
    memo.commit(keys.where("size % 7 = 0").withColumn("result", F.concat(F.lit("third "), "size")))
    return memo.latest().select("memo_key", "result", "error", F.col("generation").cast("int").alias("generation"))


def question_estimate(spark, sf):
    """Customers asked one plain question each; the answer's size decides the estimate."""

    def model(prompt: str) -> str:
        last = int(prompt.split("#")[1].split()[0])
        if last == 3:
            raise TimeoutError(prompt)
        return json.dumps({"lc50_4hr_mg_L": last - 20, "confidence": last % 10})

    named = table(spark, sf, "customer", "c_custkey", "c_name")
    rows = question_estimates(named, "c_name", model, scratch_path(spark, "memo"), floor=0.01)
    return rows.withColumn("pred_4_hr_value_mgL_log10", F.round("pred_4_hr_value_mgL_log10", 6))


QUERIES = {
    "memo_misses": memo_misses,
    "batch_infer": batch_infer,
    "memo_merge": memo_merge,
    "parse_response": responses,
    "prediction_record": prediction_record,
    "user_codec_hook": user_codec_hook,
    "codec_once": codec_once,
    "estimate_table": estimate_table,
    "estimate_table_whole": estimate_table_whole,
    "infer_waves": infer_waves,
    "memo_generations": memo_generations,
    "question_estimates": question_estimate,
}

REQUESTS_SQL = f"""
requests AS (
  SELECT conv_id, turn, text, concat(conv_id, '-', turn) AS request, {ANSWER_SQL} AS result,
    md5(CAST(to_json({{'function': 'answer', 'version': '1', 'text': text}}) AS VARCHAR)) AS memo_key
  FROM conversations),
memo AS (SELECT DISTINCT memo_key FROM requests WHERE turn = 0)
"""

ORACLE = {
    "question_estimates": """
SELECT c_custkey, c_name,
  CASE WHEN c_custkey = 3 THEN NULL WHEN c_custkey <= 20 THEN round(log10(0.01), 6)
    ELSE round(log10(c_custkey - 20), 6) END AS "pred_4_hr_value_mgL_log10",
  CASE WHEN c_custkey = 3 THEN 0.0 ELSE CAST(c_custkey % 10 AS DOUBLE) END AS "CONFIDENCE",
  CASE WHEN c_custkey = 3
    THEN concat('TimeoutError: what is the 4-hour inhalation LC50 value of ', c_name, ' in mg/L') END AS error
FROM customer
""",
    "memo_misses": f"""
WITH {REQUESTS_SQL}
SELECT DISTINCT memo_key, text FROM requests WHERE memo_key NOT IN (SELECT memo_key FROM memo)
""",
    "batch_infer": f"""
WITH {REQUESTS_SQL}
SELECT request, result,
  CASE WHEN result IS NULL THEN concat('ValueError: prompt of ', length(text), ' characters') END AS error
FROM requests
""",
    "memo_merge": f"""
WITH {REQUESTS_SQL}
SELECT conv_id, turn, CASE WHEN m.memo_key IS NOT NULL THEN concat('stored for ', length(text)) ELSE result END
  AS result, m.memo_key IS NOT NULL AS memo_hit
FROM requests LEFT JOIN memo m USING (memo_key)
""",
    "parse_response": f"""
WITH {REQUESTS_SQL}, parsed AS (SELECT request, CASE WHEN json_valid(result) THEN result END AS r FROM requests)
SELECT request, json_extract_string(r, '$.chemical_name') AS chemical_name,
  json_extract_string(r, '$.units') AS units, CAST(json_extract(r, '$.lc50') AS DOUBLE) AS lc50,
  coalesce(CAST(json_extract(r, '$.confidence') AS DOUBLE), 0.0) AS confidence
FROM parsed
""",
    "prediction_record": """
WITH e AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS dsstox, CAST(l_partkey AS VARCHAR) AS chemical_name,
    l_extendedprice - 30000 AS mg, CASE WHEN l_discount > 0 THEN l_quantity - 10 END AS ppm, l_linenumber AS c
  FROM lineitem)
SELECT dsstox, chemical_name,
  CASE WHEN mg > 0 THEN round(log10(mg / 1000), 6) END AS "pred_lc50_4hr_mg_L",
  CASE WHEN ppm > 0 THEN round(log10(ppm), 6) END AS pred_lc50_4hr_ppm,
  CASE WHEN mg > 0 THEN c ELSE 0 END AS "confidence_mgL",
  CASE WHEN ppm > 0 AND c <> 3 THEN c ELSE 0 END AS confidence_ppm,
  coalesce(mg > 0, false) OR coalesce(ppm > 0, false) AS prediction_available
FROM e
""",
    "infer_waves": f"""
WITH {REQUESTS_SQL}
SELECT conv_id, turn, CASE WHEN m.memo_key IS NOT NULL THEN concat('stored for ', length(text)) ELSE result END AS result,
  CASE WHEN m.memo_key IS NULL AND result IS NULL THEN concat('ValueError: prompt of ', length(text), ' characters') END
    AS error,
  m.memo_key IS NOT NULL AS memo_hit
FROM requests LEFT JOIN memo m USING (memo_key)
""",
    "memo_generations": f"""
WITH {REQUESTS_SQL}, keys AS (SELECT memo_key, max(length(text)) AS n FROM requests GROUP BY memo_key)
SELECT memo_key,
  CASE WHEN n % 7 = 0 THEN concat('third ', n) WHEN n % 3 = 0 AND n % 5 <> 0 THEN concat('second ', n)
    WHEN n % 2 = 0 THEN concat('first ', n) END AS result,
  CASE WHEN n % 7 <> 0 AND n % 2 <> 0 AND n % 3 = 0 AND n % 5 = 0 THEN concat('failed ', n) END AS error,
  CASE WHEN n % 7 = 0 THEN 4 ELSE 3 END AS generation
FROM keys WHERE n % 2 = 0 OR n % 3 = 0 OR n % 7 = 0
""",
    "user_codec_hook": """
SELECT p_partkey, p_name, CASE WHEN NOT contains(p_name, 'bolt') THEN reverse(p_name) END AS coded,
  contains(p_name, 'bolt') AS coded_failed
FROM part
""",
    "codec_once": """
SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment NOT LIKE 'A%' THEN lower(c_mktsegment) END AS coded,
  coalesce(c_mktsegment LIKE 'A%', false) AS coded_failed
FROM customer
""",
    "estimate_table_whole": f"""
WITH {PROMPT_WHOLE_SQL}, sized AS (SELECT dsstox, part, length(full_prompt) AS n FROM full_prompts),
best AS (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY dsstox ORDER BY n % 10 DESC, part) = 1)
SELECT dsstox, concat('compound ', dsstox) AS chemical_name,
  round(log10((n - length('milligrams_per_cubic_meter')) / 1000), 6) AS "pred_lc50_4hr_mg_L",
  round(log10(n - length('parts_per_million')), 6) AS pred_lc50_4hr_ppm,
  CAST(n % 10 AS DOUBLE) AS "confidence_mgL", CAST(n % 10 AS DOUBLE) AS confidence_ppm,
  true AS prediction_available, CAST(NULL AS VARCHAR) AS error
FROM best
""",
    "estimate_table": f"""
WITH {PROMPT_FULL_SQL}, sized AS (SELECT dsstox, length(full_prompt) AS n FROM full_prompts)
SELECT dsstox, concat('compound ', dsstox) AS chemical_name,
  round(log10((n - length('milligrams_per_cubic_meter')) / 1000), 6) AS "pred_lc50_4hr_mg_L",
  round(log10(n - length('parts_per_million')), 6) AS pred_lc50_4hr_ppm,
  CAST(n % 10 AS DOUBLE) AS "confidence_mgL", CAST(n % 10 AS DOUBLE) AS confidence_ppm,
  true AS prediction_available, CAST(NULL AS VARCHAR) AS error
FROM sized
""",
}
