"""Hard negatives by exact inner products, with lists of candidates shared by clusters of anchors.

Anchors are clustered by direction. For a cluster with centre c and widest angle b, no member's
inner product with a row x passes |member| * |x| * cos(max(0, angle(c, x) - b)). Each cluster's rows
are sorted by that bound once; every member walks its cluster's list from the top and ends as soon
as the bound of what is left certifies that nothing there can enter its result.

A list is cut into stretches, a short one first and longer ones after. A stretch is dealt in cells
of some rows and one group of members; a cell walks its own rows in the list's order, and after each
stretch the members that are certified leave.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from propflow.session import materialize

FIT_ROWS = 4096  # anchors, by hash of their id, that the centres are fitted on
CLUSTER_ANCHORS = 256
MOST_CLUSTERS = 8
GROUP_ROWS = 1024  # members of a cell
CELL_ROWS = 4096  # rows of a cell
FIRST_ROWS = 4096  # of each list in its first stretch
GROWTH = 16
STEP = 512  # rows a cell's members walk at a time
LARGEST = 1 << 26  # components are held within, so that scores of up to 1,024 of them are 64-bit numbers
_EXACT = float(1 << 53)


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Vectors of little-endian 32-bit numbers as rows, shorter ones filled with zeros."""
    rows = [np.frombuffer(v, dtype="<i4") for v in column.to_pylist()]
    width = max([width or 0, *(len(v) for v in rows)])
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < _EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _encoded(batches):
    for batch in batches:
        rows = [np.array(v, dtype="<i4") for v in batch.column("v").to_pylist()]
        norms = [float(np.sqrt(np.dot(v.astype(float), v.astype(float)))) for v in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(norms, pa.float64()), pa.array([v.tobytes() for v in rows], pa.binary())],
            ["id", "label", "norm", "vec"],
        )


def _fitted(sample: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of directions: far ones first, then rounds of assignment and mean."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    centres = unit[:1]
    while len(centres) < min(clusters, len(unit)):
        centres = np.vstack([centres, unit[np.argmin((unit @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        nearest = np.argmax(unit @ centres.T, axis=1)
        for c in range(len(centres)):
            mean = unit[nearest == c].sum(axis=0)
            if np.linalg.norm(mean) > 0:
                centres[c] = mean / np.linalg.norm(mean)
    return centres


def _angles(vectors: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    width = max(vectors.shape[1], centres.shape[1])
    vectors, centres = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (vectors, centres))
    cosines = (vectors @ centres.T) / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


def _assigned(batches, centres: np.ndarray):
    for batch in batches:
        angles = _angles(_matrix(batch.column("vec")), batch.column("norm").to_numpy(), centres)
        cluster = np.argmin(angles, axis=1)
        own = angles[np.arange(len(cluster)), cluster]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(cluster.astype(np.int32)), pa.array(own)], [*batch.schema.names, "cluster", "angle"]
        )


def _listed(batches, centres: np.ndarray, widest: np.ndarray):
    """Each row once per cluster, with its bound for members of norm 1."""
    for batch in batches:
        norms = batch.column("norm").to_numpy()
        bounds = norms[:, None] * np.cos(np.maximum(0, _angles(_matrix(batch.column("vec")), norms, centres) - widest))
        for c in range(len(centres)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, c, dtype=np.int32)), pa.array(-bounds[:, c]), batch.column("id"), batch.column("label"), batch.column("vec")],
                ["cluster", "minus", "id", "label", "vec"],
            )


class Lists:
    """Clusters of anchors and each cluster's rows, sorted by bound."""

    def __init__(self, vectors: DataFrame, anchors: DataFrame, clusters: int | None = None, first_rows: int = FIRST_ROWS):
        kinds = "id bigint, label bigint, norm double, vec binary"
        self.rows = materialize(vectors.mapInArrow(_encoded, kinds))
        members = anchors.mapInArrow(_encoded, kinds)
        sample = members.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vec").toArrow()
        wanted = clusters or min(MOST_CLUSTERS, max(1, -(-anchors.count() // CLUSTER_ANCHORS)))
        centres = _fitted(_matrix(sample.column("vec")), wanted) if len(sample) else np.zeros((1, 1))
        self.members = materialize(members.mapInArrow(lambda b: _assigned(b, centres), f"{kinds}, cluster int, angle double"))
        found = self.members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest")).collect()
        widest = np.zeros(len(centres))
        self.groups = dict.fromkeys(range(len(centres)), 1)  # of members, one row per cluster
        for r in found:
            widest[r.cluster], self.groups[r.cluster] = r.widest, -(-r.n // GROUP_ROWS)
        used = sorted(r.cluster for r in found)
        listed = self.rows.mapInArrow(
            lambda b: _listed(b, centres, widest), "cluster int, minus double, id bigint, label bigint, vec binary"
        ).where(F.col("cluster").isin(used))
        order = ["cluster", "minus", "id"]
        self.lists = materialize(listed.repartitionByRange(*order).sortWithinPartitions(*order))
        self.cuts = self._cuts(first_rows)

    def _cuts(self, first_rows: int) -> list[dict[int, tuple[float, float, int]]]:
        """Per stretch and cluster: from and below which (negated) bound it goes, and its rows."""
        size = max(1, self.rows.count())
        shares = []
        while (share := first_rows * GROWTH ** len(shares) / size) < 1:
            shares.append(share)
        ends = {}
        if shares:
            marks = F.percentile_approx("minus", F.array(*map(F.lit, shares)), F.lit(10_000))
            ends = {r.cluster: r.marks for r in self.lists.groupBy("cluster").agg(marks.alias("marks")).collect()}
        edges = {c: [-np.inf, *ends.get(c, []), np.inf] for c in self.groups}
        return [
            {c: (e[i], e[i + 1], int(size * ([*shares, 1][i] - ([0, *shares][i])))) for c, e in edges.items()}
            for i in range(len(shares) + 1)
        ]

    def walk(self, scan: Callable, limits: Callable, state: DataFrame | None, slots: int) -> DataFrame:
        """(anchor, slot, score, id) of the first `slots` rows of every slot.

        `limits(members, state)` gives each member the `need` below which no score matters, and what
        `scan` wants to know; `scan(members, scores, labels, ids, need)` picks from some rows.
        """
        best = state
        for stretch in self.cuts:
            known = limits(self.members, best)
            top = _by_cluster({c: -low if np.isfinite(low) else np.inf for c, (low, _, _) in stretch.items()})
            slack = 1e-9 * (1 + F.abs("need")) + 1e-6
            known = materialize(known.where(F.col("need").isNotNull() & ((top == float("inf")) | (F.col("need") - slack <= top * F.col("norm")))))
            if known.isEmpty():
                break
            cells = {c: max(1, -(-rows // CELL_ROWS)) for c, (_, _, rows) in stretch.items()}
            groups = F.pmod(F.xxhash64("id"), _by_cluster(self.groups).cast("long")).cast("int")
            known = known.select("*", groups.alias("grp"), F.explode(F.sequence(F.lit(0), _by_cluster(cells).cast("int") - 1)).alias("cell"))
            low, high = (_by_cluster({c: x[i] for c, x in stretch.items()}) for i in (0, 1))
            rows = self.lists.where((F.col("minus") >= low) & (F.col("minus") < high))
            cell = F.pmod(F.xxhash64("id"), _by_cluster(cells).cast("long")).cast("int")
            rows = rows.select("*", cell.alias("cell"), F.explode(F.sequence(F.lit(0), _by_cluster(self.groups).cast("int") - 1)).alias("grp"))
            keys = ["cluster", "grp", "cell"]
            found = rows.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(
                lambda _, rows, members: _cell(rows, members, scan, slots), "anchor bigint, slot int, score bigint, id bigint"
            )
            best = found if best is None else best.unionByName(found)
            order = W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
            best = materialize(best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= slots).drop("_r"))
        return best if best is not None else self.members.sparkSession.createDataFrame([], "anchor bigint, slot int, score bigint, id bigint")


def _by_cluster(values: dict[int, float]):
    """The value of the row's cluster; there are at most as many as centres."""
    found = F.lit(None)
    for c, value in values.items():
        found = F.when(F.col("cluster") == c, F.lit(value)).otherwise(found)
    return found


def _first(member: np.ndarray, slot: np.ndarray, score: np.ndarray, other: np.ndarray, slots: int) -> np.ndarray:
    """Places of the first `slots` entries of every (member, slot)."""
    order = np.lexsort((other, -score, slot, member))
    m, s = member[order], slot[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
    begin = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[place < slots]


def _cell(rows: pa.Table, members: pa.Table, scan: Callable, slots: int) -> pa.Table:
    """One cell's rows walked by its members in the order of their bounds."""
    kept = [np.zeros(0, dtype=np.int64)] * 4
    if len(rows) and len(members):
        rows = rows.sort_by([("minus", "ascending"), ("id", "ascending")])
        bound = -rows.column("minus").to_numpy()
        ids, labels = (rows.column(c).to_numpy() for c in ("id", "label"))
        vectors, anchors = _matrix(rows.column("vec")), _matrix(members.column("vec"))
        norms, need = members.column("norm").to_numpy(), members.column("need").to_numpy().copy()
        for at in range(0, len(rows), STEP):
            active = np.flatnonzero(need - 1e-9 * (1 + np.abs(need)) - 1e-6 <= bound[at] * norms)
            if not len(active):
                break
            stretch = slice(at, at + STEP)
            scores = _products(anchors[active], vectors[stretch])
            found = scan(members, active, scores, labels[stretch], ids[stretch], need[active])
            kept = [np.concatenate(pair) for pair in zip(kept, found, strict=True)]
            first = _first(*kept, slots)
            kept = [column[first] for column in kept]
            if len(kept[0]):
                need = np.maximum(need, scan.reached(members, kept, slots))
    anchor = members.column("id").to_numpy()[kept[0]] if len(members) else kept[0]
    return pa.table({"anchor": pa.array(anchor, pa.int64()), "slot": pa.array(kept[1].astype(np.int32)), "score": pa.array(kept[2].astype(np.int64)), "id": pa.array(kept[3], pa.int64())})


class Positives:
    """Rows of the anchor's label other than itself."""

    def __call__(self, members, active, scores, labels, ids, need):
        own, label = (members.column(c).to_numpy()[active] for c in ("id", "label"))
        fits = (label[:, None] == labels) & (own[:, None] != ids) & (scores >= need[:, None])
        m, r = np.nonzero(fits)
        return active[m], np.zeros(len(m), dtype=np.int64), scores[m, r], ids[r]

    def reached(self, members, kept, slots):
        member, _, score, _ = kept
        out = np.full(len(members), -np.inf)
        full = np.flatnonzero(np.bincount(member, minlength=len(members)) == slots)
        least = np.full(len(members), np.inf)
        np.minimum.at(least, member, score)
        out[full] = least[full]
        return out


class Negatives:
    """Rows of other labels with low <= score <= high for each of the anchor's positives."""

    @staticmethod
    def _bounds(members):
        lists = [[np.array(v, dtype=np.int64) for v in members.column(c).to_pylist()] for c in ("highs", "lows")]
        width = max((len(v) for v in lists[0]), default=0)
        high, low = (np.stack([np.pad(v, (0, width - len(v)), constant_values=fill) for v in side]) for side, fill in zip(lists, (-1, 0), strict=True))
        return high, low  # an absent positive has no score that fits

    def __call__(self, members, active, scores, labels, ids, need):
        label = members.column("label").to_numpy()[active]
        high, low = (side[active] for side in self._bounds(members))
        other = (label[:, None] != labels) & (scores >= need[:, None])
        parts = []
        for slot in range(high.shape[1]):
            m, r = np.nonzero(other & (scores <= high[:, slot, None]) & (scores >= low[:, slot, None]))
            parts.append((active[m], np.full(len(m), slot), scores[m, r], ids[r]))
        return [np.concatenate(column) for column in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * 4

    def reached(self, members, kept, slots):
        member, slot, score, _ = kept
        high, low = self._bounds(members)
        need = np.where(high >= low, low.astype(float), np.inf)
        cell = member * high.shape[1] + slot
        full = np.bincount(cell, minlength=need.size) == slots
        least = np.full(need.size, np.inf)
        np.minimum.at(least, cell, score)
        return np.where(full, least, need.ravel()).reshape(need.shape).min(axis=1)


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    clusters: int | None = None,
    first_rows: int = FIRST_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    vectors and anchors (rows of vectors) are (id, label, v) with v an array of whole numbers. Scores
    are inner products, higher first, equal ones by smaller id. For each anchor and each of its first
    `positives` other rows of the same label, the first `negatives` rows of other labels with
    low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score.

    Rows with a null id, label or vector or a null component take no part; of rows that share an id
    the one with the greatest label, then vector counts; shorter vectors go on as zeros; components
    are held within 2 ** 26 of zero. Empty tables give no rows; other columns are ignored.
    """
    fit = "id is not null and label is not null and v is not null and forall(v, x -> x is not null)"
    held = f"transform(v, x -> cast(greatest(least(x, {LARGEST}), -{LARGEST}) as int)) AS v"

    def cleaned(rows: DataFrame) -> DataFrame:
        one = rows.where(fit).selectExpr("cast(id as bigint) AS id", "cast(label as bigint) AS label", held)
        return one.groupBy("id").agg(F.max(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")

    lists = Lists(cleaned(vectors), cleaned(anchors), clusters, first_rows)

    def same(members: DataFrame, state: DataFrame | None) -> DataFrame:
        if state is None:
            return members.withColumn("need", F.lit(float("-inf")))
        reached = state.groupBy("anchor").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score").cast("double")).alias("need"))
        joined = members.join(reached, F.col("id") == F.col("anchor"), "left").drop("anchor")
        return joined.withColumn("need", F.coalesce("need", F.lit(float("-inf"))))

    found = lists.walk(Positives(), same, None, positives)
    order = W.partitionBy("anchor").orderBy(F.col("score").desc(), "id")  # at most `positives` rows
    chosen = materialize(found.select("anchor", (F.row_number().over(order) - 1).cast("int").alias("slot"), F.col("score").alias("high"), F.col("id").alias("positive")))
    # whole-number ends of the window; scores of 0 and below go through the same two inequalities
    high = F.expr(f"cast(floor(high * {high_percent} / 100.0BD) as bigint)")
    low = F.expr(f"cast(ceil(high * {low_percent} / 100.0BD) as bigint)")
    windows = chosen.select("anchor", "slot", high.alias("h"), low.alias("l"))

    def other(members: DataFrame, state: DataFrame | None) -> DataFrame:
        windowed = windows
        if state is not None:
            reached = state.groupBy("anchor", "slot").agg(F.when(F.count(F.lit(1)) >= negatives, F.min("score")).alias("full"))
            windowed = windowed.join(reached, ["anchor", "slot"], "left")
        else:
            windowed = windowed.withColumn("full", F.lit(None).cast("long"))
        need = F.min(F.when(F.col("h") >= F.col("l"), F.coalesce("full", "l").cast("double")))
        by_slot = F.array_sort(F.collect_list(F.struct("slot", "h", "l")))
        each = windowed.groupBy("anchor").agg(need.alias("need"), by_slot.alias("s"))
        joined = members.join(each, F.col("id") == F.col("anchor"))
        return joined.select(*members.columns, "need", F.col("s.h").alias("highs"), F.col("s.l").alias("lows"))

    mined = lists.walk(Negatives(), other, None, negatives).withColumnRenamed("id", "negative")
    rank = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "negative"))
    return mined.join(chosen, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), rank.alias("rank"),
        F.col("negative").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score"),
    )
