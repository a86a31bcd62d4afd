"""Context, model answers and their evaluation, from lookup rows to metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

from propflow.fixed_values import CONTEXT_CAP, NAME_QUESTION
from propflow.functions.annotation import with_annotation_value
from propflow.functions.keywords import matches_in_all
from propflow.functions.numbers import guarded_confidence, guarded_log10
from propflow.functions.responses import memo_key, parse_response, parse_short_response
from propflow.operators import context, evaluate, inference
from propflow.operators.crosswalk import attach_ids, build_crosswalk, unwrap_singletons
from propflow.operators.exemplars import pick_exemplars
from propflow.operators.reduction import reduce_parts
from propflow.session import materialize

ENDPOINTS = ["milligrams_per_cubic_meter", "parts_per_million"]


def lookup_rows(annotations: DataFrame, order: str, entity: str = "pub_chem_cid") -> DataFrame:
    """(dsstox, entity, heading, value, order): annotation rows under their external ids."""
    rows = with_annotation_value(unwrap_singletons(annotations, entity), "data")
    crosswalk = build_crosswalk(rows, entity, "value_text")
    slim = rows.select(entity, "heading", F.col("value_text").alias("value"), order)
    return attach_ids(slim, crosswalk, entity, "inner").select("dsstox", entity, "heading", "value", order)


def annotation_context(
    rows: DataFrame,
    entity: str,
    order: list[str],
    keywords: list[str],
    mode: str = "regex",
    cap: int = CONTEXT_CAP,
) -> DataFrame:
    """(entity, details) of the rows whose heading and value both hold a keyword, cut at `cap`."""
    return context.capped_context(*_keyword_lines(rows, entity, keywords, mode), order, cap)


def annotation_parts(
    rows: DataFrame,
    entity: str,
    order: list[str],
    keywords: list[str],
    mode: str = "regex",
    part_chars: int = CONTEXT_CAP,
) -> DataFrame:
    """(entity, part, text): the same lines whole, in ordered parts of `part_chars` characters."""
    return context.context_parts(*_keyword_lines(rows, entity, keywords, mode), order, part_chars)


def _keyword_lines(rows: DataFrame, entity: str, keywords: list[str], mode: str):
    kept = rows.where(matches_in_all([F.col("heading"), F.col("value")], keywords, mode))
    return kept, entity, F.concat(F.col("heading"), F.lit(": "), F.col("value"))


def estimate_entities(
    entities: DataFrame,
    rows: DataFrame,
    measured: DataFrame,
    keywords: list[str],
    order: list[str],
    refine: Callable[[str], str],
    model: Callable[[str, str], str],
    memo_path: str,
    version: str = "1",
    endpoint_columns: tuple[str, str] = ("mg", "ppm"),
    measured_id: str = "id",
    measured_name: str = "name",
) -> DataFrame:
    """Prediction records of `entities` (dsstox, name), asked with their context and exemplars.

    `refine(prompt)` rewrites the summary request, `model(prompt, endpoint)` answers
    as JSON. Both go through the memo table at `memo_path`.
    """
    mg, ppm = endpoint_columns
    details = annotation_context(rows, "dsstox", order, keywords)
    asked = context.summary_prompts(context.attach_context(entities, details, "dsstox"), "name")
    # each is read for the misses and again for the answers: build the texts once
    asked = materialize(asked.withColumn("memo_key", memo_key("refine", version, "prompt")))
    refined = inference.memoised_infer(asked, ["prompt"], refine, f"{memo_path}/refine")
    picked = pick_exemplars(measured, mg, measured_id)
    examples = context.exemplar_table(picked, measured_name, mg, ppm, [mg, measured_id])
    text = inference.refined_prompt(F.col("result"), F.col("prompt"))
    full = context.estimate_prompts(refined, "name", examples, text).select("dsstox", "name", "full_prompt")
    requests = inference.explode_endpoints(materialize(full), ENDPOINTS)
    requests = requests.withColumn("memo_key", memo_key("estimate", version, "endpoint", "full_prompt"))
    answers = inference.memoised_infer(requests, ["full_prompt", "endpoint"], model, f"{memo_path}/estimate")
    return _records(inference.gather_endpoints(answers, ["dsstox", "name"], ENDPOINTS))


def whole_prompts(
    entities: DataFrame,
    rows: DataFrame,
    keywords: list[str],
    order: list[str],
    examples: DataFrame,
    refine: Callable[[str], str],
    memo_path: str,
    version: str = "1",
    part_chars: int = CONTEXT_CAP,
    **asking,
) -> DataFrame:
    """(dsstox, name, part, full_prompt) of entities (dsstox, name) over all of their context.

    Context longer than a part is brought down to one by rounds of `refine` (see `reduce_parts`); an
    entity that these cannot shorten has a prompt for each of the parts that remain.
    """
    entities = materialize(entities)
    parts = annotation_parts(rows, "dsstox", order, keywords, part_chars=part_chars)
    short = reduce_parts(
        parts.join(entities, "dsstox"), "dsstox", "name", refine, f"{memo_path}/reduce", version, part_chars, **asking
    )
    details = short.select("dsstox", F.col("part").alias("_part"), F.col("text").alias("details"))
    whole = context.attach_context(entities, details, "dsstox")
    asked = context.summary_prompts(whole.withColumn("part", F.coalesce("_part", F.lit(0))).drop("_part"), "name")
    asked = materialize(asked.withColumn("memo_key", memo_key("refine", version, "prompt")).drop("prompt"))
    requests = context.summary_prompts(asked, "name")
    refined = inference.ask_in_waves(requests, ["prompt"], refine, f"{memo_path}/refine", **asking)
    text = inference.refined_prompt(F.col("result"), F.col("prompt"))
    return context.estimate_prompts(refined, "name", examples, text).select("dsstox", "name", "part", "full_prompt")


def estimate_whole(
    entities: DataFrame,
    rows: DataFrame,
    measured: DataFrame,
    keywords: list[str],
    order: list[str],
    refine: Callable[[str], str],
    model: Callable[[str, str], str],
    memo_path: str,
    version: str = "1",
    endpoint_columns: tuple[str, str] = ("mg", "ppm"),
    measured_id: str = "id",
    measured_name: str = "name",
    part_chars: int = CONTEXT_CAP,
    **asking,
) -> DataFrame:
    """Prediction records as by `estimate_entities`, from all of each entity's context.

    Requests go in waves, each committed to the memo before the next. Of an entity asked in several
    parts the most confident answer counts, the earlier part of equal ones.
    """
    mg, ppm = endpoint_columns
    picked = pick_exemplars(measured, mg, measured_id)
    examples = context.exemplar_table(picked, measured_name, mg, ppm, [mg, measured_id])
    full = whole_prompts(entities, rows, keywords, order, examples, refine, memo_path, version, part_chars, **asking)
    requests = inference.explode_endpoints(materialize(full), ENDPOINTS)
    requests = requests.withColumn("memo_key", memo_key("estimate", version, "endpoint", "full_prompt"))
    answers = inference.ask_in_waves(requests, ["full_prompt", "endpoint"], model, f"{memo_path}/estimate", **asking)
    best = W.partitionBy("dsstox", "endpoint").orderBy(
        F.col("error").isNull().desc(), parse_response(F.col("result"))["confidence"].desc_nulls_last(), "part"
    )
    slim = answers.select("dsstox", "name", "endpoint", "part", "result", "error")
    first = slim.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")
    wide = inference.gather_endpoints(first, ["dsstox", "name"], ENDPOINTS)
    return _records(wide)


def _records(wide: DataFrame) -> DataFrame:
    first, second = ENDPOINTS
    return evaluate.prediction_records(
        wide, "dsstox", "name", f"lc50_{first}", f"lc50_{second}",
        f"confidence_{first}", f"confidence_{second}", keep=("error",),
    )


def question_estimates(
    entities: DataFrame, name: str, model: Callable[[str], str], memo_path: str, floor: float, version: str = "1"
) -> DataFrame:
    """Each entity with one plain question's log10 estimate and confidence, floored at `floor`."""
    asked = entities.withColumn("prompt", F.format_string(NAME_QUESTION, F.col(name)))
    asked = asked.withColumn("memo_key", memo_key("question", version, "prompt"))
    answers = inference.memoised_infer(asked, ["prompt"], model, memo_path)
    answer = parse_short_response(F.col("result"), "mg_L")
    value = answer["lc50"]
    return answers.select(
        *entities.columns,
        guarded_log10(value, floor=floor).alias("pred_4_hr_value_mgL_log10"),
        guarded_confidence(value, answer["confidence"], floor=True).alias("CONFIDENCE"),
        "error",
    )


def evaluated(predictions: DataFrame, measured: DataFrame, measured_id: str, actual: tuple[str, str]) -> dict:
    """Joined rows with both predictions present, their overall metrics and the threshold sweep."""
    joined = predictions.join(measured, F.col("dsstox") == F.col(measured_id))
    rows = joined.na.drop("any", subset=["pred_lc50_4hr_mg_L", "pred_lc50_4hr_ppm"])
    units = {
        "mg/L": (actual[0], "pred_lc50_4hr_mg_L", "confidence_mgL"),
        "ppm": (actual[1], "pred_lc50_4hr_ppm", "confidence_ppm"),
    }
    overall = {(unit, "all"): columns[:2] for unit, columns in units.items()}
    return {
        "rows": rows,
        "overall": evaluate.compare_versions(rows, overall),
        "sweep": evaluate.threshold_sweep(rows, units),
    }


