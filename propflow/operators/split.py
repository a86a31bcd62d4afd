"""Train and test split of an exact size."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, functions as F

from propflow.operators.ordering import nth_smallest_hash


def split_exact(
    df: DataFrame, key: str, fraction: float = 0.1, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Adds 'test' for the ceil(fraction * n) smallest hashes of (seed, key), else 'train'.

    `key` is unique per row. The cut is one value, so no row moves.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    hashes = df.select(hashed.alias("hash"))
    cut = nth_smallest_hash(hashes, "hash", ceil(round(fraction * hashes.count(), 6)))
    part = F.when(hashed <= F.lit(cut), "test").otherwise("train")
    return df.withColumn(out, part)
