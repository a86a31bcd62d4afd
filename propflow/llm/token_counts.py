"""An exact histogram of encoded lengths, and what its suffix sums tell about every context limit."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that this vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTHS_PER_GROUP = 256


def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _lengths(batches, vocabulary: bytes):
    encoder = _encoder(vocabulary)
    for batch in batches:
        counts = [len(encoder.encode_ordinary(t.as_py() or "")) for t in batch.column("text")]
        values, docs = np.unique(np.array(counts, dtype=np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(docs.astype(np.int64))], ["n_tokens", "n_docs"])


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length; null texts have length 0.

    Whole texts are encoded, special tokens as ordinary text. The vocabulary file, some MB at most,
    is read on the driver and sent along; batches leave their tasks already counted.
    """
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    lengths = docs.select("text").mapInArrow(
        lambda batches: _lengths(batches, shared.value), "n_tokens bigint, n_docs bigint"
    )
    return lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def length_report(histogram: DataFrame) -> DataFrame:
    """One row per length L, read as a context limit.

    docs_over, tokens_over: documents longer than L and their tokens; docs_within, tokens_within:
    the others; truncated_tokens: what remains when every document is cut at L; quantile: the share
    of documents no longer than L. Any limit between two lengths follows from the row below it.
    Sums run inside groups of neighbouring lengths, group totals give the rest.
    """
    group = F.floor(F.col("n_tokens") / LENGTHS_PER_GROUP)
    rows = histogram.withColumns({"_tokens": F.col("n_tokens") * F.col("n_docs"), "_group": group})
    totals = rows.groupBy("_group").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    above = W.orderBy(F.desc("_group")).rowsBetween(W.unboundedPreceding, -1)  # one row per group
    after = totals.select(
        "_group",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_tokens_after"),
    )
    inside = W.partitionBy("_group").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.join(after, "_group").withColumns(
        {
            "docs_over": F.col("_docs_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)),
            "tokens_over": F.col("_tokens_after") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0)),
        }
    )
    whole = totals.agg(F.sum("_d").alias("_all_docs"), F.sum("_t").alias("_all_tokens"))
    sums = sums.join(F.broadcast(whole))  # one row
    return sums.select(
        "n_tokens",
        "n_docs",
        "docs_over",
        "tokens_over",
        (F.col("_all_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("_all_tokens") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("_all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("_all_docs") - F.col("docs_over")) / F.col("_all_docs")).alias("quantile"),
    )
