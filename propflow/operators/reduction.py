"""Long texts brought down to one part by rounds of refining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from propflow.fixed_values import CONTEXT_CAP
from propflow.functions.responses import memo_key
from propflow.operators import context, inference
from propflow.session import materialize


def reduce_parts(
    parts: DataFrame,
    entity: str,
    name: str,
    refine: Callable[[str], str],
    memo_path: str,
    version: str = "1",
    part_chars: int = CONTEXT_CAP,
    **asking,
) -> DataFrame:
    """(entity, name, part, text): one part per entity, by rounds over parts (entity, name, part, text).

    A round asks for a summary of every part of the entities that have several, through the memo;
    the answers, in order, are joined by line ends and cut into parts of `part_chars` again. A part
    whose request fails goes on with its own text. Entities down to one part are done. An entity that
    a round leaves with no fewer parts than before keeps those it had, so every round shortens what
    it takes on and all text stays in. No task holds more than a part at a time; each round is
    written. `asking` goes to `ask_in_waves`.
    """
    columns = [entity, name, "part", "text"]

    def keyed(rows: DataFrame) -> DataFrame:
        prompts = context.summary_prompts(rows.select(*columns, F.col("text").alias("details")), name)
        return materialize(prompts.withColumn("memo_key", memo_key("refine", version, "prompt")).drop("prompt", "details"))

    todo, done = keyed(parts), None
    while True:
        sizes = materialize(todo.groupBy(entity).agg(F.count(F.lit(1)).alias("_parts")))  # few rows: no text moves to meet them
        single = todo.join(sizes.where("_parts = 1").select(entity), entity, "left_semi").select(*columns)
        done = single if done is None else done.unionByName(single)
        asked = todo.join(sizes.where("_parts > 1").select(entity), entity, "left_semi")
        if asked.isEmpty():
            return done.select(*columns)
        # the prompt holds the text: it is built again where it is sent
        requests = context.summary_prompts(asked.withColumnRenamed("text", "details"), name)
        answers = inference.ask_in_waves(requests, ["prompt"], refine, memo_path, **asking)
        answers = answers.select(entity, "part", "memo_key", "result")  # no text moves beside its answer
        refined = answers.where("result is not null").select(entity, "part", F.trim("result").alias("_line"))
        failed = materialize(answers.where("result is null").select("memo_key").distinct())
        own = asked.join(failed, "memo_key", "left_semi").select(entity, "part", F.col("text").alias("_line"))
        joined = materialize(context.context_parts(refined.unionByName(own), entity, F.col("_line"), ["part"], part_chars))
        after = joined.groupBy(entity).agg(F.count(F.lit(1)).alias("_after"))
        before = asked.groupBy(entity, name).agg(F.count(F.lit(1)).alias("_parts")).join(after, entity)
        shorter = materialize(before.where("_after < _parts").select(entity, name))
        stuck = asked.join(shorter.select(entity), entity, "left_anti")
        done = done.unionByName(stuck.select(*columns))
        todo = keyed(joined.join(shorter, entity))
