"""Documents placed by a tree of weighted hash draws: region, rack, shard.

A node's draw is the least draw of the shards below it. The least of exponential draws is itself
an exponential draw at the summed rate, so every level is a weighted hash draw between subtrees,
and descending to the least draw at each level agrees with the least shard draw of all. A changed
weight alters the draws of its own subtree alone: rows move only into a node that gained weight
or out of one that lost it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

Tree = dict[str, dict[str, dict[int, float]]]

SHARDS_PER_RACK = 4
RACKS_PER_REGION = 2
_UNIT = 1.0 / (1 << 53)


def layout(shards: int) -> Tree:
    """A regular tree of equal shards; one more shard extends the last rack or opens the next."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // SHARDS_PER_RACK
        region = rack // RACKS_PER_REGION
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def _draw(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit("shard"), F.lit(shard)), 11).cast("double")
    return -F.log((bits + 0.5) * F.lit(_UNIT)) / F.lit(float(weight))


def _least(nodes: list[Column]) -> Column:
    return nodes[0] if len(nodes) == 1 else F.least(*nodes)


def place(key: Column, tree: Tree) -> Column:
    """Struct (draw, region, rack, shard) of the shard that a key descends to.

    Shards of weight 0 get no rows. A null key is a key like any other; ties, which need equal
    53-bit draws, go to the first name.
    """
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [
                F.struct(
                    _draw(key, shard, weight).alias("draw"),
                    F.lit(region).alias("region"),
                    F.lit(rack).alias("rack"),
                    F.lit(shard).alias("shard"),
                )
                for shard, weight in shards.items()
                if weight > 0
            ]
            if leaves:
                inner.append(_least(leaves))
        if inner:
            regions.append(_least(inner))
    if not regions:
        raise ValueError("the tree has no shard with weight")
    return _least(regions)


def assign_shards(docs: DataFrame, tree: Tree, key: str = "doc_id") -> DataFrame:
    """All rows and columns with `region`, `rack` and `shard`; same-named columns are replaced.

    One narrow projection: no shuffle, no state, equal keys share a shard.
    """
    placed = place(F.col(key), tree)
    return docs.withColumns(
        {"region": placed["region"], "rack": placed["rack"], "shard": placed["shard"]}
    )


def shard_slots(docs: DataFrame, tree: Tree, grown: Tree, rows_per_group: int = 100_000) -> DataFrame:
    """One row per document: size, checksum, shard, place within the shard, shard in the grown tree.

    Places run from 0 without gaps, by hash group and then doc_id. Each shard is numbered in many
    hash groups whose totals give the offsets, and equal rows count as one row with a multiplicity,
    so neither a large shard nor a repeated row meets in one task. Null texts have size 1 and
    checksum 0; null ids are placed like any id; an empty table gives an empty result.
    """
    text = F.col("text")
    leaves = max(1, sum(len(s) for racks in tree.values() for s in racks.values()))
    buckets = max(64, docs.count() // (leaves * rows_per_group))
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    rows = docs.select(
        F.col("doc_id"),
        size.alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_m"))
    equal = equal.select(
        "*",
        place(F.col("doc_id"), tree)["shard"].alias("shard"),
        place(F.col("doc_id"), grown)["shard"].alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("_sub"),
    )
    inside = W.partitionBy("shard", "_sub").orderBy("doc_id", "size", "text_crc32")
    earlier = F.sum("_m").over(inside.rowsBetween(W.unboundedPreceding, -1))
    placed = equal.withColumn("_before", F.coalesce(earlier, F.lit(0)))
    totals = equal.groupBy("shard", "_sub").agg(F.sum("_m").alias("_n"))
    lower = W.partitionBy("shard").orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("shard", "_sub", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_start"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("_copy")
    joined = placed.join(offsets, ["shard", "_sub"]).select("*", copies)
    return joined.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("_start") + F.col("_before") + F.col("_copy")).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )
