"""Expressions over bracket symbols and token arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from propflow.fixed_values import PACK_LIMITS

# Fixed value: a bracketed symbol, or the dot between two fragments.
SYMBOL_PATTERN = r"\[[^\]]*\]|\."


def split_symbols(text: Column) -> Column:
    """`[C][=C].[O]` as an array of symbols; null and '' give an empty array."""
    found = F.regexp_extract_all(text, F.lit(SYMBOL_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def pad_right(tokens: Column, length: Column | int, pad: int = 0) -> Column:
    """Exactly `length` tokens: cut on the right or filled with `pad`; null gives all pad."""
    length = length if isinstance(length, Column) else F.lit(length)
    present = F.coalesce(tokens, F.array().cast("array<int>"))
    return F.slice(F.concat(present, F.array_repeat(F.lit(pad), length)), F.lit(1), length)


def pack_sequence(
    symbols: Column,
    prop: Column,
    value: Column,
    start_id: Column | int,
    property_id: Column | int,
    value_id: Column | int,
    limits: tuple[int, int, int] = PACK_LIMITS,
    drop_first: tuple[int, int, int] = (0, 0, 0),
) -> Column:
    """start + symbols + property mark + property + value mark + value; null if a part is null."""

    def part(tokens: Column, skip: int, limit: int) -> Column:
        return F.slice(tokens, skip + 1, limit)

    def mark(token: Column | int) -> Column:
        return F.array((token if isinstance(token, Column) else F.lit(token)).cast("int"))

    return F.concat(
        mark(start_id),
        part(symbols, drop_first[0], limits[0]),
        mark(property_id),
        part(prop, drop_first[1], limits[1]),
        mark(value_id),
        part(value, drop_first[2], limits[2]),
    )


def labels_of(tokens: Column, pad: int = 0, mask_pad: bool = False, masked: int = -100) -> Column:
    """Training labels: the tokens themselves, pads optionally replaced by `masked`."""
    if not mask_pad:
        return tokens
    return F.transform(tokens, lambda t: F.when(t == pad, F.lit(masked)).otherwise(t))
