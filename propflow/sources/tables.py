"""Readers: Parquet assets, keyword files, vocabulary files, result sheets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from propflow.fixed_values import VOCAB_SPECIALS


def snake(name: str) -> str:
    """`DSSTOX_SUBSTANCE_ID`, `PubChemCID`, `4_hr_value_mgL` as lower snake case."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z][A-Za-z])", "_", name.strip())
    return re.sub(r"\W+", "_", spaced).lower()


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail while the plan is built, not after the scan has started."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not among {df.columns}")
    return df


def read_table(spark: SparkSession, path: str, *columns: str, normalise: bool = False) -> DataFrame:
    """One Parquet file or a whole directory of parts, pruned to `columns`."""
    df = spark.read.parquet(path)
    if normalise:
        df = df.toDF(*map(snake, df.columns))
    return require_columns(df, *columns).select(*columns) if columns else df


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """A text file of one keyword per line as distinct trimmed lower-case rows."""
    keyword = F.lower(F.trim("value"))
    return spark.read.text(path).select(keyword.alias("keyword")).where("keyword <> ''").distinct()


def keyword_list(keywords: DataFrame, limit: int = 10_000) -> list[str]:
    """The keywords on the driver; refuses a list too long for one pattern."""
    rows = keywords.orderBy("keyword").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} keywords: join them instead of one pattern")
    return [row.keyword for row in rows]


def vocabulary_of_json(docs: DataFrame, column: str, field: str = "symbol_to_index") -> DataFrame:
    """(symbol, idx) of a JSON text column `{field: {symbol: idx}}`, specials left out."""
    parsed = F.from_json(F.col(column), f"`{field}` map<string,int>")
    pairs = docs.select(F.explode(parsed.getField(field)).alias("symbol", "idx"))
    return pairs.where(~F.col("symbol").isin(VOCAB_SPECIALS))


def read_vocabulary(spark: SparkSession, path: str, field: str = "symbol_to_index") -> DataFrame:
    """The vocabulary of a JSON file."""
    return vocabulary_of_json(spark.read.text(path, wholetext=True), "value", field)


def read_sheet(spark: SparkSession, path: str, schema: str, line_breaks: bool = True) -> DataFrame:
    """A result sheet written by `write_sheet`; without `line_breaks` in values its files can be split."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", line_breaks)
        .option("escape", '"')
        .csv(path)
    )


def unescaped_breaks(text: Column) -> Column:
    """The text that `escaped_breaks` put on one line."""

    def plain(piece: Column) -> Column:
        return F.replace(F.replace(piece, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))

    # between pairs of backslashes, taken from the left, each backslash left starts a code
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def read_split_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sheet written by `write_split_sheet`; large files are read by several tasks."""
    df = read_sheet(spark, path, schema, line_breaks=False)
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    return df.withColumns({c: unescaped_breaks(F.col(c)) for c in texts})


def union_parts(*frames: DataFrame) -> DataFrame:
    """Union by name; a column absent from one part is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
