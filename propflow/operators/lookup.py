"""Sorted index and exact-match lookup of token sequences."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from propflow.operators.ordering import global_rank
from propflow.operators.range_join import cell_of
from propflow.session import materialize


def sorted_index(store: DataFrame, tokens: str, row_id: str, out: str = "place") -> DataFrame:
    """Adds the 0-based place of each sequence in lexicographic order, ties by `row_id`."""
    return global_rank(store, tokens, row_id, out=out, first=0)


def first_matches(store: DataFrame, tokens: str, row_id: str, payload: list[str]) -> DataFrame:
    """One row per distinct sequence and its hash: the payload of its first row.

    Copies collapse before the shuffle, which the lookup then shares.
    """
    hashed = store.withColumn("_hash", F.xxhash64(tokens))
    firsts = hashed.groupBy("_hash", tokens).agg(
        F.min_by(F.struct(row_id, *payload), row_id).alias("_first")
    )
    names = [row_id, *payload]
    return firsts.select("_hash", tokens, *(F.col(f"_first.{name}").alias(name) for name in names))


def lookup_sequences(
    queries: DataFrame, store: DataFrame, tokens: str, row_id: str, payload: list[str]
) -> DataFrame:
    """Each query with the payload of the first stored row of equal tokens, else nulls."""
    firsts = first_matches(store, tokens, row_id, payload).withColumnRenamed(tokens, "_stored")
    asked = queries.withColumn("_hash", F.xxhash64(tokens))
    same = (asked["_hash"] == firsts["_hash"]) & (F.col(tokens) == F.col("_stored"))
    return asked.join(firsts, same, "left").drop("_hash", "_stored")


class StoredIndex:
    """Distinct sequences in lexicographic order at a path, with the first and last one of each file.

    A lookup sends every asked sequence to the one file whose range holds it and reads only the files
    that are asked. The table of ends has a row per file.
    """

    def __init__(self, spark: SparkSession, path: str, tokens: str, row_id: str, payload: list[str]):
        self.spark, self.tokens, self.row_id, self.payload = spark, tokens, row_id, payload
        self._rows, self._ends = f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/ends"

    def write(self, store: DataFrame, files: int | None = None) -> StoredIndex:
        """Stores the first row of each sequence, replacing what was there; null sequences are left out."""
        firsts = first_matches(store.where(F.col(self.tokens).isNotNull()), self.tokens, self.row_id, self.payload)
        ranged = firsts.repartitionByRange(*([files] if files else []), self.tokens).sortWithinPartitions(self.tokens)
        ranged.write.mode("overwrite").parquet(self._rows)
        ends = self.spark.read.parquet(self._rows).groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(self.tokens).alias("first"), F.max(self.tokens).alias("last")
        )
        ends.write.mode("overwrite").parquet(self._ends)
        return self

    def _asked(self, queries: DataFrame, files: list) -> DataFrame:
        """(_asked, _hash, _file) of the distinct asked sequences that lie within a file's range."""
        kind = queries.schema[self.tokens].dataType.simpleString()
        firsts, lasts = (F.from_json(F.lit(json.dumps(ends)), f"array<{kind}>") for ends in ([f.first for f in files], [f.last for f in files]))
        asked = queries.where(F.col(self.tokens).isNotNull()).select(F.col(self.tokens).alias("_asked")).distinct()
        asked = asked.withColumn("_file", cell_of(F.col("_asked"), firsts, len(files)) - 1)
        return asked.where((F.col("_file") >= 0) & (F.col("_asked") <= F.get(lasts, F.col("_file")))).withColumn("_hash", F.xxhash64("_asked"))

    def ranges(self, queries: DataFrame) -> DataFrame:
        """The stored rows of the files that hold asked sequences."""
        return self._meeting(queries)[1]

    def _meeting(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        files = sorted(self.spark.read.parquet(self._ends).collect(), key=lambda r: r.first)
        schema = self.spark.read.parquet(self._rows).schema
        asked = materialize(self._asked(queries, files))
        numbers = sorted(r._file for r in asked.select("_file").distinct().collect())  # at most one per file
        if not numbers:
            return asked, self.spark.createDataFrame([], schema)
        return asked, self.spark.read.schema(schema).parquet(*(files[i].file for i in numbers))

    def lookup(self, queries: DataFrame) -> DataFrame:
        """Each query with the payload of the first stored row of equal tokens, else nulls."""
        asked, rows = self._meeting(queries)
        rows = rows.withColumnsRenamed({self.tokens: "_stored", "_hash": "_of"})
        found = rows.join(asked, (F.col("_of") == F.col("_hash")) & (F.col("_stored") == F.col("_asked")))
        found = found.select("_asked", "_hash", self.row_id, *self.payload)
        same = (F.xxhash64(queries[self.tokens]) == found["_hash"]) & (queries[self.tokens] == found["_asked"])
        return queries.join(found, same, "left").drop("_asked", "_hash")
