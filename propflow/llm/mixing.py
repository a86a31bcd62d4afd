"""Sources mixed to token targets by entropy balancing.

Document rates tilt exponentially away from one: rate = exp(lambda of the document's source). The
multipliers solve the convex dual  sum(size * exp(lambda)) - lambda * target  by Newton steps, each
from the sources' moments, which Spark sums over the documents. Rates are then rounded into copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propflow.operators.ordering import global_rank
from propflow.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
NEWTON_STEPS = 40
HASH_GROUPS = 4096
BLOCK_BITS = 14  # of the rows that are numbered together


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES
) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn and share all words; a target stops
    at `most` times its source's size and the excess is shared anew until none is above. Each round
    is two sums over the sources; every round but the last settles at least one source.
    """
    named = sources.select("source", F.col("source_size").cast("long"), F.col("source").isNull().alias("_last"))
    ranked = global_rank(named, "_last", "source", out="_rank", first=0)
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rank") % len(weights) + 1).cast("int")
    )
    ranked = materialize(
        ranked.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(most))).alias("_cap"))
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    scale, settled = None, -1
    while True:
        over = F.lit(False) if scale is None else F.col("_w") * F.lit(scale) > F.col("_cap")
        row = ranked.agg(
            F.sum(F.when(over, F.col("_cap")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(over, 0.0).otherwise(F.col("_w"))).alias("free"),
            F.sum(over.cast("long")).alias("n"),
        ).first()
        if not row.free or row.n == settled:
            break
        scale, settled = (total - row.fixed) / row.free, row.n
    share = F.least(F.col("_w") * F.lit(scale or 0.0), F.col("_cap"))
    return ranked.select("source", "source_size", share.alias("target"))


def tilt(target: Column, size: Column, steps: int = NEWTON_STEPS) -> Column:
    """The multiplier of a source: Newton on its dual, steps held to one in size.

    The gradient is size * exp(lambda) - target and the second derivative size * exp(lambda).
    """
    def step(at: Column, _: Column) -> Column:
        moment = size * F.exp(at)
        change = (target - moment) / moment
        return at + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), change))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), step)
    return F.when((size > 0) & (target > 0), solved)


def _shares(docs: DataFrame, keys: list[Column], **options) -> DataFrame:
    """(`_k0`.., source, size, source_size, target, _m, _whole, _more) for each set of equal rows.

    Each of the `_m` rows gets `_whole` copies and `_more` of them one copy more. All documents of a source share a rate; each gets its whole part as copies, and documents in
    hash order get one copy more until the source's remaining words are spent, so a source misses
    its target by at most half of its largest document. Running sums stay inside hash groups of a
    source, offsets come from the groups' totals, and equal rows are one row with a multiplicity.
    `keys` must name a row; rows equal in all keys are interchangeable.
    """
    rows = docs.select(
        F.col("source"), word_count(F.col("text")).alias("size"), *(k.alias(f"_k{i}") for i, k in enumerate(keys))
    )
    names = [f"_k{i}" for i in range(len(keys))]
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, **options)
    rate = F.exp(tilt(F.col("target"), F.col("source_size").cast("double")))
    whole = F.floor(rate + F.lit(1e-9)).cast("long")
    rates = targets.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.coalesce(whole, F.lit(0)).alias("_whole"),
    )
    rates = rates.withColumn("_extra", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
    equal = rows.groupBy("source", "size", *names).agg(F.count(F.lit(1)).alias("_m"))
    equal = equal.withColumn("_h", F.xxhash64(F.lit("mix"), "size", *names))
    equal = equal.withColumn("_group", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(HASH_GROUPS)).cast("int"))
    words = F.col("size") * F.col("_m")
    order = W.partitionBy("source", "_group").orderBy("_h", "size", *names)
    before = F.coalesce(F.sum(words).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = equal.withColumn("_before", before)
    totals = equal.groupBy("source", "_group").agg(F.sum(words).alias("_words"))
    lower = W.partitionBy("source").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        F.col("source").alias("_from"),
        F.col("_group").alias("_at"),
        F.coalesce(F.sum("_words").over(lower), F.lit(0)).alias("_start"),
    )
    starts = starts.join(rates, F.col("_from").eqNullSafe(F.col("_source")))
    same = F.col("source").eqNullSafe(F.col("_from")) & (F.col("_group") == F.col("_at"))
    room = F.col("_extra") - F.col("_start") - F.col("_before")
    fits = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5).cast("long")).otherwise(F.lit(0))
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("_m"), fits))
    return placed.join(starts, same).withColumn("_more", more).select(
        *names, "source", "size", "source_size", "target", "_m", "_whole", "_more"
    )


def mixed_copies(docs: DataFrame, keys: list[Column], **options) -> DataFrame:
    """(key columns `_k0`.., source, size, source_size, target, copies) for every document row."""
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))).alias("_copy")
    return _shares(docs, keys, **options).select("*", each).select(
        *(f"_k{i}" for i in range(len(keys))),
        "source",
        "size",
        "source_size",
        "target",
        (F.col("_whole") + (F.col("_copy") <= F.col("_more")).cast("long")).alias("copies"),
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document row.

    Null sources form one source, null and empty texts have no words and take none, an empty table
    gives an empty result, and reruns agree.
    """
    keys = [F.col("doc_id"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0))]
    copies = mixed_copies(docs, keys, **options)
    return copies.select(
        F.col("_k0").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.col("copies").cast("int").alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: each row as often as it has copies, all columns kept.

    Of rows equal in source, id and text as many get the extra copy as `mix_report` counts. Where
    only some do, rows are numbered inside blocks of at most 2 ** BLOCK_BITS, and blocks that come
    first take the extra copies. Documents without words take none and stay once: they weigh nothing
    in any target.
    """
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0))
    shares = _shares(docs, [F.col("doc_id"), crc], **options).select(
        F.col("_k0").alias("_mix_id"),
        F.col("_k1").alias("_mix_crc"),
        F.col("source").alias("_mix_source"),
        F.col("size").alias("_mix_size"),
        F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("_whole")).cast("int").alias("_mix_n"),
        F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("_more")).cast("long").alias("_mix_more"),
        F.col("_m").alias("_mix_m"),
    )
    shares = materialize(shares)
    split = (F.col("_mix_more") > 0) & (F.col("_mix_more") < F.col("_mix_m"))
    same = (
        F.col("doc_id").eqNullSafe(F.col("_mix_id"))
        & (crc == F.col("_mix_crc"))
        & F.col("source").eqNullSafe(F.col("_mix_source"))
        & (word_count(F.col("text")) == F.col("_mix_size"))
    )
    alike = shares.where(~split).withColumn("_mix_n", F.col("_mix_n") + (F.col("_mix_more") > 0).cast("int"))
    rows = docs.join(alike.where("_mix_n > 0"), same).select(*docs.columns, "_mix_n")
    uneven = shares.where(split)
    if not uneven.isEmpty():
        at = F.monotonically_increasing_id()
        # places and blocks must not change between counting and numbering
        placed = materialize(docs.withColumn("_mix_at", at).join(uneven, same))
        placed = placed.withColumn("_mix_block", F.shiftright("_mix_at", BLOCK_BITS))
        keys = ["_mix_source", "_mix_size", "_mix_id", "_mix_crc"]
        counts = placed.groupBy(*keys, "_mix_block").agg(F.count(F.lit(1)).alias("_n"))
        earlier = W.partitionBy(*keys).orderBy("_mix_block").rowsBetween(W.unboundedPreceding, -1)
        ahead = counts.select(
            *(F.col(k).alias(f"_of{k}") for k in (*keys, "_mix_block")), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead")
        )
        number = F.row_number().over(W.partitionBy(*keys, "_mix_block").orderBy("_mix_at"))
        own = [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in (*keys, "_mix_block")]
        numbered = placed.withColumn("_mix_number", number).join(ahead, own)
        more = (F.col("_ahead") + F.col("_mix_number") <= F.col("_mix_more")).cast("int")
        dealt = numbered.withColumn("_mix_n", F.col("_mix_n") + more).where("_mix_n > 0")
        rows = rows.unionByName(dealt.select(*docs.columns, "_mix_n"))
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_mix_n"))).alias("_mix_copy")).drop("_mix_copy")
