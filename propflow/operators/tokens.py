"""Vocabularies: fit, extend, encode, pad to the longest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from propflow.functions.symbols import pad_right
from propflow.operators.ordering import global_rank
from propflow.session import materialize


def fit_vocabulary(df: DataFrame, symbols: Column, specials: list[str] | None = None) -> DataFrame:
    """(symbol, idx) of all distinct symbols, dense and in symbol order after the specials.

    Symbols are counted before they move, so a symbol found in every row costs nothing.
    """
    specials = specials or []
    seen = df.select(F.explode(symbols).alias("symbol")).where("symbol is not null")
    if specials:
        seen = seen.where(~F.col("symbol").isin(specials))
    ranked = global_rank(seen.distinct(), "symbol", out="idx", first=len(specials))
    ranked = ranked.select("symbol", F.col("idx").cast("int").alias("idx"))
    if not specials:
        return ranked
    fixed = [(symbol, i) for i, symbol in enumerate(specials)]
    return df.sparkSession.createDataFrame(fixed, "symbol string, idx int").unionByName(ranked)


def extend_vocabulary(base: DataFrame, symbols: DataFrame) -> DataFrame:
    """The base vocabulary plus unknown symbols, numbered on from its largest index."""
    unknown = symbols.select("symbol").distinct().join(base, "symbol", "left_anti")
    start = base.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).scalar()
    ranked = global_rank(unknown, "symbol", out="_nth", first=0)
    added = ranked.withColumn("_start", start)
    return base.select("symbol", "idx").unionByName(
        added.select("symbol", (F.col("_nth") + F.col("_start")).cast("int").alias("idx"))
    )


def encode_columns(
    df: DataFrame,
    columns: dict[str, str],
    vocabulary: DataFrame,
    unknown: int = 0,
) -> DataFrame:
    """Adds index arrays of symbol arrays (`columns`: array to new name).

    Symbols outside the vocabulary and null symbols give `unknown`; a symbol that the vocabulary
    repeats has its least index. Null arrays stay null. One plan at any vocabulary size: rows get a
    tag and are written once, symbols are joined, and the tag puts the arrays together again, so
    repeated or null keys do no harm.
    """
    tagged = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    codes = vocabulary.where("symbol is not null").groupBy("symbol").agg(F.min("idx").alias("_idx"))
    # arrays are told apart by their place among `columns`
    arrays = F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns))
    each = tagged.select("_row", F.posexplode(arrays).alias("_array", "_symbols"))
    symbols = each.select("_row", "_array", F.posexplode("_symbols").alias("_at", "symbol"))
    coded = symbols.join(codes, "symbol", "left").withColumn("_code", F.coalesce("_idx", F.lit(unknown)))
    found = F.array_sort(F.collect_list(F.struct("_array", "_at", "_code")))
    out = tagged.join(coded.groupBy("_row").agg(found.alias("_found")), "_row", "left")
    for i, (symbols_of, name) in enumerate(columns.items()):
        own = F.filter("_found", lambda c: c["_array"] == i)  # noqa: B023 - called at once
        whole = F.coalesce(F.transform(own, lambda c: c["_code"].cast("int")), F.array().cast("array<int>"))
        out = out.withColumn(name, F.when(F.col(symbols_of).isNotNull(), whole))
    return out.drop("_row", "_found")


def encode_padded(
    df: DataFrame,
    symbols: str,
    vocabulary: DataFrame,
    out: str,
    length: int,
    pad: int,
    unknown: int,
    oov: str = "unk",
) -> DataFrame:
    """Index arrays cut or filled to one length; `oov="pad"` gives unknown symbols the pad index."""
    missing = pad if oov == "pad" else unknown
    coded = encode_columns(df, {symbols: out}, vocabulary, missing)
    return coded.withColumn(out, pad_right(F.col(out), length, pad))


def pad_to_longest(df: DataFrame, tokens: str, out: str, pad: int = 0) -> DataFrame:
    """Every array filled up to the longest one; the length is a scalar subquery."""
    longest = df.agg(F.max(F.size(tokens))).scalar()
    sized = df.withColumn("_longest", longest)
    return sized.withColumn(out, pad_right(F.col(tokens), F.col("_longest"), pad)).drop("_longest")
