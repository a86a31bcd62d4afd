"""Documents joined by the Jaccard similarity of their word shingles, as a blocked sparse product.

Rows of the incidence matrix are the distinct shingle sets, columns the shingles, in the order of
how often they occur. A pair at or above the threshold shares a column among the leading ones of
both rows, so the product is taken over those columns, within blocks of like set sizes. A cell is
made only where the sizes and the places of the column in both rows leave enough for the bound: the
first column that two rows share has the rest of their overlap behind it. The overlap of a pair that
meets is counted over its leading columns first, pairs that can no longer reach the bound are
discarded, and the rest are counted whole.

Components need links, not all cells: each round multiplies every column's rows with one leading row
only, at first the one that others were most likely copied from, and what then still joins different
components in a column is multiplied out, so nothing that could link is left unlooked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from propflow.llm.components import components
from propflow.llm.hashing import lists, mix, shingle_sets, text_slices
from propflow.session import materialize

PERCENT = 80
FREQUENT = 1 << 22  # at most so many shingles are put last: 32 MB
LEAST_FREQUENT = 16
POOL = 2 << 20  # shingles whose repetitions a task counts at a time
BROADCAST_IDS = 1_000_000
OPEN_CELLS = 4  # cells left between components, per cell of the leading columns, that are multiplied out
STAR_ROUNDS = 3


def _repeated(pool: list[np.ndarray]) -> pa.RecordBatch:
    """Rows for the shingles that a pool of rows holds twice or more."""
    every = np.concatenate(pool)
    pool.clear()
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    counts = np.diff(np.append(first, len(every)))
    values, counts = every[first[counts > 1]], counts[counts > 1]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.nulls(len(values), pa.int64()),
            "n": pa.array(counts.astype(np.int64)),
            "k1": pa.array(values.view(np.int64)),
            "k2": pa.nulls(len(values), pa.int64()),
            "often": pa.array(np.ones(len(values), dtype=bool)),
        }
    )


def _keys(batches):
    """Per row: set size and a 128-bit key of the set; beside them shingles that a task sees again."""
    pool, held = [], 0
    for batch in batches:
        for at, offsets, data in text_slices(batch.column("text")):
            rows = len(offsets) - 1
            row, hashed = shingle_sets(offsets, data)
            n = np.bincount(row, minlength=rows)
            key = np.zeros((2, rows), dtype=np.uint64)
            for k, salt in enumerate((np.uint64(0x1234567), np.uint64(0x89ABCDEF01))):
                np.add.at(key[k], row, mix(hashed ^ salt))
            pool.append(hashed)
            held += len(hashed)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(at, rows),
                    "n": pa.array(n.astype(np.int64)),
                    "k1": pa.array(key[0].view(np.int64)),
                    "k2": pa.array(key[1].view(np.int64)),
                    "often": pa.array(np.zeros(rows, dtype=bool)),
                }
            )
            if held >= POOL:
                yield _repeated(pool)
                pool, held = [], 0
    if held:
        yield _repeated(pool)


def _sets(batches, frequent: tuple[np.ndarray, np.ndarray] | None, percent: int):
    """Whole sets, or with `frequent` (hashes, ranks) the leading columns of each row in the order rank, hash.

    Beside them the share of a row's shingles that are frequent ones.
    """
    for batch in batches:
        for at, offsets, data in text_slices(batch.column("text")):
            rows = len(offsets) - 1
            row, hashed = shingle_sets(offsets, data)
            n = np.bincount(row, minlength=rows)
            known = np.zeros(rows)
            if frequent is not None:
                keys, ranks = frequent
                if len(keys) and len(hashed):
                    spot = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
                    rank = np.where(keys[spot] == hashed, ranks[spot], 0)
                    known = np.bincount(row, weights=rank > 0, minlength=rows) / np.maximum(n, 1)
                    order = np.lexsort((hashed, rank, row))
                    row, hashed = row[order], hashed[order]
                first = np.concatenate([[0], np.cumsum(n)])[:-1]
                place = np.arange(len(row)) - first[row]
                leading = place < (n - (percent * n + 99) // 100 + 1)[row]
                row, hashed = row[leading], hashed[leading]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(at, rows),
                    "n": pa.array(n.astype(np.int64)),
                    "known": pa.array(known),
                    "shingles": lists(row, hashed, rows),
                }
            )


def _packed(n: Column, place: Column, known: Column) -> Column:
    """Set size, place of the column and percent of frequent shingles in one number, as they move with every cell."""
    return F.shiftleft(n, 33).bitwiseOR(F.shiftleft(place.cast("long"), 7)).bitwiseOR(F.round(known * 100).cast("long"))


def _size(w: str) -> Column:
    return F.shiftright(w, 33)


def _place(w: str) -> Column:
    return F.shiftright(w, 7).bitwiseAND(F.lit((1 << 26) - 1))


def _known(w: str) -> Column:
    return F.col(w).bitwiseAND(F.lit(127))


def _promising(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs that can reach their bound, by the overlap in their leading columns.

    What two rows share up to the earlier of their last leading columns is counted in full; beyond
    it one of them has but its remaining columns.
    """
    left = heads.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("head").alias("ha"))
    right = heads.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("head").alias("hb"))
    rest = lambda n: F.ceil(n * (percent / 100) - 1e-9) - 1
    most = F.size(F.array_intersect("ha", "hb")) + F.greatest(rest(F.col("na")), rest(F.col("nb"))) + 1
    needed = F.lit(percent) * (F.col("na") + F.col("nb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where((100 + percent) * most >= needed).select("a", "b")


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole overlap reaches the bound; sets are made anew from the texts."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    few = ids.count() <= BROADCAST_IDS  # 8 bytes each; beyond that Spark picks the join
    chosen = texts.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("rep"), "left_semi")
    sets = materialize(
        chosen.mapInArrow(
            lambda batches: _sets(batches, None, percent), "doc_id bigint, n bigint, known double, shingles array<bigint>"
        )
    )
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return both.where(100 * shared >= percent * union).select("a", "b")


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of (a, na, b, nb) whose sizes allow the threshold."""
    sized = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Equal sets are one row of the matrix, whatever their number. A null, empty or blank text has no
    shingles and is its own component; null ids are never a component's name, a component of null
    ids alone has none. Rows of one id are one document. Empty tables give empty results.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = materialize(
        texts.mapInArrow(_keys, "doc_id bigint, n bigint, k1 bigint, k2 bigint, often boolean")
    )
    rows = keyed.where("not often").select("doc_id", "n", "k1", "k2")
    classes = rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    reps = materialize(classes.where("rep is not null"))
    # a frequent shingle takes at least its share of all: their number is bounded, whatever the data
    total = rows.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_FREQUENT, -(-total // FREQUENT))
    often = keyed.where("often").groupBy("k1").agg(F.sum("n").alias("c")).where(F.col("c") >= least).toArrow()
    hashes, counts = often.column("k1").to_numpy().view(np.uint64), often.column("c").to_numpy()
    by_hash = np.argsort(hashes)
    hashes, counts = hashes[by_hash], counts[by_hash]
    ranks = np.empty(len(hashes), dtype=np.int32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1, len(hashes) + 1)
    shared_frequent = spark.sparkContext.broadcast((hashes, ranks))

    leading = materialize(
        texts.mapInArrow(
            lambda batches: _sets(batches, shared_frequent.value, percent),
            "doc_id bigint, n bigint, known double, shingles array<bigint>",
        ).where("n > 0 and doc_id is not null")
    )
    cells = leading.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(
        F.col("doc_id").alias("rep"), "n", "known", F.posexplode("shingles").alias("place", "s")
    )
    cells = cells.select("rep", "s", _packed(F.col("n"), F.col("place"), F.col("known")).alias("w"))
    shared = leading.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.join(shared.where("c > 1").select("s"), "s", "left_semi")
    # similar sizes differ by one band at most, so each row lies in two overlapping blocks
    band = F.floor(F.log(_size("w").cast("double")) / F.lit(math.log(100.0 / percent)))
    cells = cells.withColumn("band", band)
    cells = materialize(cells.select("s", "rep", "w", "band", F.explode(F.array("band", F.col("band") + 1)).alias("block")))
    heads = materialize(
        cells.where("block = band").groupBy("rep").agg(F.first(_size("w")).alias("n"), F.collect_list("s").alias("head"))
    )
    cells = cells.drop("band")
    n_cells = cells.count()

    by = ["s", "block"]
    roots = spark.createDataFrame([], "rep bigint, root bigint")
    checked = spark.createDataFrame([], "a bigint, b bigint")
    links = checked

    # the first column that two rows share leaves the later ones of both for the rest of their overlap
    in_reach = (100 + percent) * F.least(_size("w") - _place("w"), _size("wb") - _place("wb")) >= percent * (_size("w") + _size("wb"))

    def placed() -> DataFrame:
        return cells.join(roots, "rep", "left").select(*by, "rep", "w", F.coalesce("root", "rep").alias("root"))

    def settle(pairs: DataFrame) -> None:
        nonlocal roots, checked, links
        fresh = materialize(_bounded(pairs, percent).join(checked, ["a", "b"], "left_anti"))
        checked = checked.unionByName(fresh)
        likely = materialize(_promising(fresh, heads, percent))
        found = materialize(_linked(likely, texts, percent))
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links).select(F.col("node").alias("rep"), "root")

    for attempt in range(STAR_ROUNDS):
        # first the row that holds least of its own: what the others of a column were copied from
        turn = F.xxhash64(F.lit(attempt), "rep")
        if attempt == 0:
            turn = F.shiftleft(100 - _known("w"), 56).bitwiseOR(F.shiftrightunsigned(turn, 8))
        lead = placed().groupBy(*by).agg(
            F.min_by("rep", turn).alias("b"),
            F.min_by("w", turn).alias("wb"),
            F.min_by("root", turn).alias("rb"),
            F.min("root").alias("low"),
            F.max("root").alias("high"),
        )
        star = placed().join(lead.where("low < high"), by).where("root <> rb").where(in_reach)
        settle(star.select(F.col("rep").alias("a"), _size("w").alias("na"), "b", _size("wb").alias("nb")))
        sized = placed().groupBy(*by, "root").agg(F.count(F.lit(1)).alias("c")).groupBy(*by)
        unmet = (F.pow(F.sum("c"), F.lit(2.0)) - F.sum(F.col("c") * F.col("c"))) / 2
        if (sized.agg(unmet.alias("u")).agg(F.sum("u")).first()[0] or 0) <= OPEN_CELLS * n_cells:
            break
    # what still joins two components in a column: all of it, each pair once
    mixed = materialize(
        placed().groupBy(*by).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(*by)
    )
    left = placed().join(mixed, by, "left_semi")
    right = left.select(*by, F.col("rep").alias("b"), F.col("w").alias("wb"), F.col("root").alias("rb"))
    crossed = left.join(right, by).where("root < rb").where(in_reach)
    settle(crossed.select(F.col("rep").alias("a"), _size("w").alias("na"), "b", _size("wb").alias("nb")))

    named = rows.join(reps, ["n", "k1", "k2"], "left").join(roots, "rep", "left")
    return named.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "rep", "doc_id").alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that name their component, one of each group, all columns kept.

    A document without id stays, as it cannot name a group; rows that share an id stay together.
    """
    found = shingle_components(docs.select("doc_id", "text"), percent)
    names = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_copy_id")).distinct()
    same = F.col("doc_id").cast("long") == F.col("_copy_id")
    return docs.join(names, same, "left_anti")
