"""From symbol strings, properties and values to packed, padded and split training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from propflow.fixed_values import SEPARATOR_SYMBOLS
from propflow.functions.symbols import labels_of, pack_sequence, split_symbols
from propflow.operators.split import split_exact
from propflow.operators.tokens import encode_columns, extend_vocabulary, fit_vocabulary, pad_to_longest
from propflow.session import materialize

SPECIALS = ["<pad>", "<unk>", "<sos>", *SEPARATOR_SYMBOLS]


def words(text: Column) -> Column:
    """Lower-case words of a text, the tokens of properties and values."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def build_vocabulary(rows: DataFrame, symbols: str, prop: str, value: str) -> DataFrame:
    """Specials, then bracket symbols, then the words of properties and values."""
    base = fit_vocabulary(rows, split_symbols(F.col(symbols)), SPECIALS)
    texts = rows.select(F.explode(F.concat(words(F.col(prop)), words(F.col(value)))).alias("symbol"))
    return materialize(extend_vocabulary(base, texts))


def tokenised(
    rows: DataFrame, key: str, symbols: str, prop: str, value: str, vocabulary: DataFrame
) -> DataFrame:
    """Adds the three token arrays and their packed sequence `tensor`; rows with a null part are left out."""
    known = rows.where(
        F.col(symbols).isNotNull() & F.col(prop).isNotNull() & F.col(value).isNotNull()
    ).withColumns(
        {
            "_symbols": split_symbols(F.col(symbols)),
            "_prop": words(F.col(prop)),
            "_value": words(F.col(value)),
        }
    )
    ids = {name: i for i, name in enumerate(SPECIALS)}
    names = {
        "_symbols": "split_selfies_tokenized",
        "_prop": "property_tokenized",
        "_value": "value_tokenized",
    }
    coded = encode_columns(known, names, vocabulary, ids["<unk>"])
    tensor = pack_sequence(
        F.col("split_selfies_tokenized"),
        F.col("property_tokenized"),
        F.col("value_tokenized"),
        ids["<sos>"],
        ids["<property>"],
        ids["<value>"],
    )
    return coded.withColumn("tensor", tensor).drop("_symbols", "_prop", "_value")


def training_rows(
    packed: DataFrame, key: str, fraction: float = 0.1, seed: int = 42, mask_pad: bool = False
) -> DataFrame:
    """(key, input_ids, labels, split): packed sequences padded to the longest, split exactly."""
    # read for the longest length, for the hashes of the split and for the rows
    stored = materialize(packed.select(key, "tensor"))
    padded = pad_to_longest(stored, "tensor", "input_ids").drop("tensor")
    labelled = padded.withColumn("labels", labels_of(F.col("input_ids"), 0, mask_pad))
    return split_exact(labelled, key, fraction, seed)
