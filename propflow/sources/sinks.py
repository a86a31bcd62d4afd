"""Writers: Parquet, lookup layout, ragged arrays, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> str:
    """Snappy Parquet; `files` compacts the output with one shuffle."""
    out = df.repartition(files) if files else df
    out.write.mode(mode).option("compression", "snappy").parquet(path)
    return path


def compact_parts(spark: SparkSession, source: str, target: str, rows_per_file: int = 5_000_000) -> str:
    """Rewrite many parts as fewer files; source and target must differ."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("compacting a path onto itself would read what it deletes")
    parts = spark.read.parquet(source)
    files = max(1, -(-parts.count() // rows_per_file))
    return write_table(parts, target, files=files)


def write_lookup(df: DataFrame, path: str, key: str, then: list[str] | None = None) -> str:
    """Rows sorted by `key` across the files, so a lookup reads few row groups.

    `then` adds columns to the range so that one hot key spreads over many files.
    """
    order = [key, *(then or [])]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> str:
    """A table bucketed and sorted by `key`; later joins on it skip their shuffle."""
    (
        df.write.mode("overwrite")
        .format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )
    return table


def write_sheet(df: DataFrame, path: str, columns: list[str], order: str | None = None) -> str:
    """CSV with a header and the columns in the given order; `order` sorts the rows across the files."""
    rows = df.orderBy(order) if order else df
    rows.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def escaped_breaks(text: Column) -> Column:
    r"""The text on one line: backslash, line feed and carriage return as `\\`, `\n` and `\r`."""
    for plain, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def write_split_sheet(df: DataFrame, path: str, columns: list[str], order: str | None = None) -> str:
    """A sheet without line breaks inside values, which many tasks can read at once; blanks at the ends stay."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name in columns]
    lines = df.withColumns({c: escaped_breaks(F.col(c)) for c in texts})
    rows = lines.orderBy(order) if order else lines
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select(*columns).write.mode("overwrite").options(**options).csv(path)
    return path
