"""Snippets round mentions, the best of them per entity, and their prompt."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from propflow.fixed_values import SEARCH_QUERY, SNIPPET_PROMPT, SNIPPET_TOP, SNIPPET_WINDOW
from propflow.functions.text import mention_windows, snippet_score

OUTPUT_CHARS = 8_000_000


def explode_snippets(
    df: DataFrame, text: str, name: str, alias: str, keep: list[str], window: int = SNIPPET_WINDOW
) -> DataFrame:
    """One row per mention: the kept columns, `pos` (0-based), `start` and `snippet`.

    Python slices in constant time where `substring` walks the text from its start
    for every mention, so long texts full of mentions stay linear. Rows leave in
    batches of bounded size, however much text one input batch repeats.
    """
    asked = {"_text": text, "_name": name, "_alias": alias}
    inputs = df.select(*keep, *(F.col(c).cast("string").alias(out) for out, c in asked.items()))
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int, str]] = []
            size = 0
            for row, texts in enumerate(zip(*(batch.column(c) for c in asked), strict=True)):
                mentions = mention_windows(*(t.as_py() for t in texts), window)
                for pos, (start, snippet) in enumerate(mentions):
                    found.append((row, pos, start, snippet))
                    size += len(snippet)
                    if size > OUTPUT_CHARS:
                        yield emit(batch, found)
                        found, size = [], 0
            if found:
                yield emit(batch, found)

    def emit(batch: pa.RecordBatch, found: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        rows, *columns = zip(*found, strict=True)
        source = pa.array(rows, pa.int32())
        arrays = [batch.column(c).take(source) for c in keep]
        types = (pa.int32(), pa.int32(), pa.string())
        arrays += [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [*keep, "pos", "start", "snippet"])

    return inputs.mapInArrow(cut, f"{kept}, pos int, start int, snippet string")


def score_snippets(snippets: DataFrame, name: str, alias: str, **terms: list[str]) -> DataFrame:
    """Adds `score`; term lists may be given by name."""
    return snippets.withColumn("score", snippet_score(F.col("snippet"), F.col(name), F.col(alias), **terms))


def top_snippets(scored: DataFrame, entity: str, order: list[str], k: int = SNIPPET_TOP) -> DataFrame:
    """The `k` best snippets per entity, equal scores in the order of `order`.

    Spark limits ranks within every input partition first, so a hot entity sends
    `k` rows per partition.
    """
    best = W.partitionBy(entity).orderBy(F.desc("score"), *order)
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def search_query(df: DataFrame, name: str, out: str = "query") -> DataFrame:
    """Adds the search text for an entity name."""
    return df.withColumn(out, F.format_string(SEARCH_QUERY, F.col(name)))


def snippet_prompts(entities: DataFrame, top: DataFrame, entity: str, name: str, alias: str) -> DataFrame:
    """Adds `prompt`: the best snippets, blank lines between them, in the question."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "snippet")))
    blobs = F.array_join(F.transform(ordered, lambda r: r["snippet"]), "\n\n")
    joined = entities.join(top.groupBy(entity).agg(blobs.alias("_blobs")), entity, "left")
    text = F.format_string(
        SNIPPET_PROMPT, F.col(name), F.col(alias), F.coalesce("_blobs", F.lit(""))
    )
    return joined.withColumn("prompt", text).drop("_blobs")
