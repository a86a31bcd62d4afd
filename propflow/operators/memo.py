"""A table of answers by request key: laid out by key prefix, written in generations, compacted now and then.

`<path>/data/generation=<n>/prefix=<digits>/` holds the rows of one commit, `<path>/log` a row per commit.
A commit counts once its log row is there, so what a lost job left behind is never read, and the next
commit replaces it. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

LOG_SCHEMA = "generation bigint, base boolean"
ROW_SCHEMA = "memo_key string, result string, error string, generation bigint, prefix string"
DIGITS = 2


class Memo:
    """Answers stored under hex keys; `digits` of a key name its folder."""

    def __init__(self, spark: SparkSession, path: str, digits: int = DIGITS):
        self.spark, self.digits = spark, digits
        self._data, self._log = f"{path.rstrip('/')}/data", f"{path.rstrip('/')}/log"

    def prefix(self, key: str = "memo_key"):
        return F.substring(key, 1, self.digits)

    def _commits(self) -> list[tuple[int, bool]]:
        """(generation, whether it holds all earlier ones), a row per commit."""
        try:
            rows = self.spark.read.schema(LOG_SCHEMA).parquet(self._log).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((r.generation, r.base) for r in rows)

    def generations(self) -> list[int]:
        """The generations that count: the last compacted one and those after it."""
        commits = self._commits()
        base = max((n for n, whole in commits if whole), default=0)
        return [n for n, _ in commits if n >= base]

    def rows(self, prefixes: list[str] | None = None, generations: list[int] | None = None) -> DataFrame:
        """(memo_key, result, error, generation, prefix) as stored; only the folders of `prefixes` are read."""
        live = self.generations() if generations is None else generations
        if not live:
            return self.spark.createDataFrame([], ROW_SCHEMA)
        paths = [f"{self._data}/generation={n}" for n in live]
        stored = self.spark.read.schema(ROW_SCHEMA).option("basePath", self._data).parquet(*paths)
        return stored if prefixes is None else stored.where(F.col("prefix").isin(prefixes))

    def latest(self, prefixes: list[str] | None = None) -> DataFrame:
        """(memo_key, result, error, generation): of each key the last answer, or the last error where none was ever given.

        Within a generation the greatest answer counts.
        """
        answered = F.col("error").isNull().alias("answered")
        last = F.max(F.struct(answered, "generation", "result", "error")).alias("last")
        found = self.rows(prefixes).groupBy("memo_key").agg(last)
        return found.select("memo_key", "last.result", "last.error", "last.generation")

    def commit(self, answers: DataFrame) -> int:
        """Stores (memo_key, result, error) rows as the next generation, straight from the tasks that make them."""
        return self._write(answers.withColumn("prefix", self.prefix()), base=False)

    def compact(self) -> int:
        """The last row of every key as one generation, a file per prefix; earlier ones are read no more."""
        rows = self.latest().select("memo_key", "result", "error", self.prefix().alias("prefix"))
        return self._write(rows.repartition("prefix").sortWithinPartitions("prefix", "memo_key"), base=True)

    def _write(self, rows: DataFrame, base: bool) -> int:
        n = max((n for n, _ in self._commits()), default=0) + 1
        rows = rows.select("memo_key", "result", "error", "prefix")
        rows.write.mode("overwrite").partitionBy("prefix").parquet(f"{self._data}/generation={n}")
        self.spark.createDataFrame([(n, base)], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self._log)
        return n
