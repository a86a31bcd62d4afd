"""A stored table that can be asked by two keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MOST_FILES = 1000


class IndexedTable:
    """Rows sorted by one key, and for a second one a table of the files that hold each of its values.

    `<path>/rows` is sorted by `key`, so a lookup by it reads the row groups whose range holds it.
    `<path>/files` is (second key, file), sorted by the second key; a lookup by it reads the few row
    groups with the asked values, then only the files they name, where bloom filters skip row groups.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, second: str):
        self.spark, self.key, self.second = spark, key, second
        self._rows, self._files = f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/files"

    def write(self, df: DataFrame, then: list[str] | None = None, rows_per_file: int = 5_000_000) -> IndexedTable:
        """Stores `df`, replacing what was there; `then` spreads a hot key over several files."""
        order = [self.key, *(then or [])]
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
        writer = ranged.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
        writer.option(f"parquet.bloom.filter.enabled#{self.second}", "true").parquet(self._rows)
        stored = self.spark.read.parquet(self._rows)
        pairs = stored.select(F.col(self.second).alias("value"), F.col("_metadata.file_path").alias("file")).distinct()
        pairs.repartitionByRange("value", "file").sortWithinPartitions("value", "file").write.mode("overwrite").parquet(self._files)
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self._rows)

    def by_key(self, values: list) -> DataFrame:
        """The rows whose first key is one of `values`."""
        return self.rows().where(F.col(self.key).isin(values))

    def by_second(self, values: list, most_files: int = MOST_FILES) -> DataFrame:
        """The rows whose second key is one of `values`.

        Up to `most_files` files are named one by one; where more hold them, all are scanned.
        """
        index = self.spark.read.parquet(self._files).where(F.col("value").isin(values))
        files = [r.file for r in index.select("file").distinct().limit(most_files + 1).collect()]
        schema = self.rows().schema
        if not files:
            return self.spark.createDataFrame([], schema)
        rows = self.rows() if len(files) > most_files else self.spark.read.schema(schema).parquet(*sorted(files))
        return rows.where(F.col(self.second).isin(values))
