"""Per-entity text: capped context, digests in parts, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propflow.fixed_values import (
    CONTEXT_CAP,
    CONTEXT_SUFFIX,
    DIGEST_HEAD,
    DIGEST_MIDDLE,
    DIGEST_TAIL,
    ESTIMATE_PROMPT,
    EXEMPLAR_HEADER,
    SUMMARY_PROMPT,
)
from propflow.functions.numbers import fixed4, mg_per_m3, ppm
from propflow.operators.ordering import range_sorted, rank_in_group
from propflow.session import materialize


def _within_reach(df: DataFrame, group: list[str], order: list[str], sep: int, reach: int) -> DataFrame:
    """Rows that start no later than `reach` characters into their group's joined text."""
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_line") + sep).over(before), F.lit(0))
    return df.withColumn("_start", start).where(F.col("_start") <= reach).drop("_start")


def capped_context(
    rows: DataFrame,
    entity: str,
    line: Column,
    order: list[str],
    cap: int = CONTEXT_CAP,
    suffix: str = CONTEXT_SUFFIX,
    sep: str = "\n",
    spread: int | None = None,
) -> DataFrame:
    """(entity, details): the lines in order, joined, cut after `cap` characters.

    A row's start within a share of its group is never later than within the whole
    group, so each share can drop what lies beyond the cap by itself. A hot entity
    is first thinned in `spread` shares; the group that then meets in one task
    holds at most `spread` times the cap.
    """
    spread = spread or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = cap + len(sep)
    lines = rows.select(
        entity, *(c for c in order if c != entity), F.substring(line, 1, cap + 1).alias("_line")
    ).where("_line is not null")
    if spread > 1:
        lines = lines.withColumn("_share", F.pmod(F.xxhash64(*order), F.lit(spread)))
        lines = _within_reach(lines, [entity, "_share"], order, len(sep), reach)
    lines = _within_reach(lines, [entity], order, len(sep), reach)
    sorted_lines = F.array_sort(F.collect_list(F.struct(*order, "_line")))
    text = F.array_join(F.transform(sorted_lines, lambda r: r["_line"]), sep)
    joined = lines.groupBy(entity).agg(text.alias("_text"))
    cut = F.when(
        F.length("_text") > cap, F.concat(F.substring("_text", 1, cap), F.lit(suffix))
    ).otherwise(F.col("_text"))
    return joined.select(entity, cut.alias("details"))


def context_parts(
    rows: DataFrame, entity: str, line: Column, order: list[str], part_chars: int = CONTEXT_CAP, sep: str = "\n"
) -> DataFrame:
    """(entity, part, text): the lines in order, joined, whole, in parts of `part_chars` characters.

    The parts of an entity set side by side are its text. A hot entity spreads over range
    partitions; only its character count per partition meets in one place, and no task holds more
    than a part at a time.
    """
    lines = rows.select(F.col(entity).alias("_entity"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), line.alias("_line"))
    sorted_lines = range_sorted(lines.where("_line is not null"), "_entity", *(f"_o{i}" for i in range(len(order))), "_line")
    width = F.length("_line") + len(sep)
    pieces = sorted_lines.groupBy("_part", "_entity").agg(F.sum(width).alias("_chars"))
    earlier = W.partitionBy("_entity").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ahead = pieces.select(
        F.col("_part").alias("_at"), F.col("_entity").alias("_of"), F.coalesce(F.sum("_chars").over(earlier), F.lit(0)).alias("_ahead")
    )
    ahead = materialize(ahead)  # where it is small, Spark sees so and the lines need not move to meet it
    before = W.partitionBy("_part", "_entity").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    local = sorted_lines.withColumn("_before", F.coalesce(F.sum(width).over(before), F.lit(0)))
    placed = local.join(ahead, (F.col("_part") == F.col("_at")) & F.col("_entity").eqNullSafe(F.col("_of")))
    start = F.col("_ahead") + F.col("_before")
    # every line but an entity's first brings its separator along
    text = F.when(start == 0, F.col("_line")).otherwise(F.concat(F.lit(sep), F.col("_line")))
    placed = placed.select("_entity", text.alias("_text"), F.greatest(start - len(sep), F.lit(0)).alias("_start"))
    last = F.greatest(F.col("_start") + F.length("_text") - 1, F.col("_start"))
    parts = F.sequence(F.floor(F.col("_start") / part_chars), F.floor(last / part_chars))
    cut = placed.select("*", F.explode(parts).alias("part"))
    low = F.greatest(F.col("part") * part_chars - F.col("_start"), F.lit(0))
    high = (F.col("part") + 1) * part_chars - F.col("_start")
    piece = F.substring(F.col("_text"), (low + 1).cast("int"), (high - low).cast("int"))
    cut = cut.select("_entity", F.col("part").cast("int").alias("part"), "_start", piece.alias("_piece"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("_start", "_piece"))), lambda r: r["_piece"])
    return cut.groupBy("_entity", "part").agg(F.array_join(joined, "").alias("text")).select(F.col("_entity").alias(entity), "part", "text")


def attach_context(entities: DataFrame, context: DataFrame, entity: str) -> DataFrame:
    """Every entity with its details; '' where it has none."""
    return entities.join(context, entity, "left").withColumn("details", F.coalesce("details", F.lit("")))


def entity_digest(
    rows: DataFrame, entity: str, heading: str, value: str, order: str, rows_per_part: int = 1000
) -> DataFrame:
    """(entity, section, part, text): distinct headings joined by ', ', values by ' '.

    Parts have a fixed row count. Those of a section, joined in order, are its whole
    text; no task holds more than one part.
    """
    headings = (
        rows.where(F.col(heading).isNotNull())
        .groupBy(entity, F.col(heading).alias("text"))
        .agg(F.min(order).alias("_order"))
        .withColumn("section", F.lit("headings"))
    )
    values = rows.where(F.col(value).isNotNull()).select(
        entity, F.col(value).alias("text"), F.col(order).alias("_order"), F.lit("details").alias("section")
    )
    keys = [entity, "section"]
    ranked = rank_in_group(headings.unionByName(values), keys, ["_order"], out="_row")
    parts = ranked.withColumn("part", F.floor(F.col("_row") / rows_per_part).cast("int"))
    pieces = F.array_sort(F.collect_list(F.struct("_row", "text")))
    texts = F.transform("pieces", lambda r: r["text"])
    joined = F.when(F.col("section") == "headings", F.array_join(texts, ", ")).otherwise(F.array_join(texts, " "))
    grouped = parts.groupBy(*keys, "part").agg(pieces.alias("pieces"))
    return grouped.select(*keys, "part", joined.alias("text"))


def digest_prompts(digest: DataFrame, entity: str) -> DataFrame:
    """(entity, step, part, text): the digest prompt in pieces to be read in that order."""
    digest = materialize(digest)
    joiner = F.when(F.col("part") == 0, F.lit("")).when(F.col("section") == "headings", F.lit(", "))
    pieces = digest.select(
        entity,
        F.when(F.col("section") == "headings", 1).otherwise(3).alias("step"),
        "part",
        F.concat(F.coalesce(joiner, F.lit(" ")), F.col("text")).alias("text"),
    )
    frame = F.array(
        F.struct(F.lit(0).alias("step"), F.format_string(DIGEST_HEAD, F.col(entity)).alias("text")),
        F.struct(F.lit(2).alias("step"), F.lit(DIGEST_MIDDLE).alias("text")),
        F.struct(F.lit(4).alias("step"), F.lit(DIGEST_TAIL).alias("text")),
    )
    fixed = digest.select(entity).distinct().select(entity, F.inline(frame))
    return pieces.unionByName(fixed.withColumn("part", F.lit(0)).select(entity, "step", "part", "text"))


def exemplar_table(exemplars: DataFrame, name: str, mg_l: str, ppm_value: str, order: list[str]) -> DataFrame:
    """One row, `examples_text`: header and a tab-separated line per exemplar.

    Exemplars are a handful by construction (two per interval and the extremes).
    """
    line = F.concat(
        F.coalesce(F.col(name), F.lit("nan")),
        F.lit("\t"),
        F.coalesce(fixed4(mg_per_m3(F.col(mg_l))), F.lit("nan")),
        F.lit("\t"),
        F.coalesce(fixed4(ppm(F.col(ppm_value))), F.lit("nan")),
        F.lit("\n"),
    )
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    body = F.array_join(F.transform(rows, lambda r: r["_line"]), "")
    return exemplars.agg(F.concat(F.lit(EXEMPLAR_HEADER), body).alias("examples_text"))


def summary_prompts(entities: DataFrame, name: str) -> DataFrame:
    """Adds `prompt`, the request to summarise an entity's details."""
    return entities.withColumn("prompt", F.format_string(SUMMARY_PROMPT, F.col(name), F.col("details")))


def estimate_prompts(entities: DataFrame, name: str, examples: DataFrame, refined: Column) -> DataFrame:
    """Adds `full_prompt`: exemplar table, refined summary, question."""
    text = F.format_string(ESTIMATE_PROMPT, F.col("_examples"), refined, F.col(name))
    return (
        entities.withColumn("_examples", examples.select("examples_text").scalar())
        .withColumn("full_prompt", text)
        .drop("_examples")
    )
