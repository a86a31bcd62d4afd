"""Documents judged by an interpolated modified Kneser-Ney model of characters, trained on trusted text.

With gamma(h) the back-off weight of a context and p_k the interpolated chance at order k,

    log p(w | h) = floor + sum over k of  log gamma(h_k) + [log p_k - log gamma(h_k) - log p_(k-1)]

where an unseen gram or context adds nothing. So a text's score is a plain sum of one weight per
gram, whatever shard of the model that gram lies in.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propflow.llm.hashing import SLICE_BYTES
from propflow.session import materialize

ORDER = 4
POOL = 2 << 20  # grams counted at a time in a task
BROADCAST_IDS = 1_000_000  # trusted ids, 8 bytes each, that travel to the texts instead of the texts to them
SHARD_ROWS = 4 << 20  # grams of the model that one pass over the documents holds: 64 MB
FOLDS = 2  # of the trusted texts, each judged by the model of the others
QUANTILE = 0.99  # of the trusted texts of a language
GRID = 1000  # log perplexities are ranked on a grid of 1 / GRID
_START, _END, _OTHER = 2, 3, 4


def _runs(column: pa.Array):
    """(first row, rows, grams by place, row of each) for runs of texts; symbols are 16-bit."""
    texts = [t.as_py() or "" for t in column]
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SLICE_BYTES):
            size += len(texts[stop])
            stop += 1
        parts, lengths = [], []
        edge = np.full(ORDER - 1, _START, dtype=np.uint64)
        for text in texts[at:stop]:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            codes = np.where(codes > 0xFFFF, np.uint64(_OTHER), codes)
            parts += [edge, codes, np.array([_END], dtype=np.uint64)]
            lengths.append(len(codes) + ORDER)
        codes = np.concatenate(parts)
        ends = np.cumsum(lengths)
        gram = np.zeros(len(codes) - ORDER + 1, dtype=np.uint64)
        for k in range(ORDER):
            gram = (gram << np.uint64(16)) | codes[k : k + len(gram)]
        row = np.searchsorted(ends, np.arange(len(gram)), side="right")
        whole = np.arange(len(gram)) + ORDER <= ends[row]
        yield at, stop - at, gram[whole], row[whole]
        at = stop


def _counts(batches):
    pool, held = defaultdict(list), 0

    def counted():
        for fold, grams in sorted(pool.items()):
            values, counts = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), fold, dtype=np.int32)), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))],
                ["fold", "g", "c"],
            )

    for batch in batches:
        folds = batch.column("fold").to_numpy()
        for at, rows, gram, row in _runs(batch.column("text")):
            own = folds[at : at + rows][row]
            for fold in np.unique(own).tolist():
                pool[fold].append(gram[own == fold])
            held += len(gram)
            if held >= POOL:
                yield from counted()
                pool, held = defaultdict(list), 0
    yield from counted()


def gram_counts(texts: DataFrame, folds: int) -> DataFrame:
    """(m, g, c): how often each gram of the highest order occurs outside fold `m`; in all texts, where `m` is `folds`.

    Texts (text, fold) are read once and pre-counted in the tasks.
    """
    counted = texts.select("fold", "text").mapInArrow(_counts, "fold int, g bigint, c bigint")
    total = F.sum("c")
    own = [F.sum(F.when(F.col("fold") == k, F.col("c")).otherwise(0)) for k in range(folds)]
    models = [F.struct(F.lit(k).alias("m"), (total - part).alias("c")) for k, part in enumerate([*own, F.lit(0)])]
    return counted.groupBy("g").agg(F.array(*models).alias("models")).select("g", F.inline("models")).where("c > 0").select("m", "g", "c")


def _discounts(n: list[int]) -> list[float]:
    """The discounts for counts of one, two and more, from the numbers of grams seen once to four times."""
    n1, n2 = n[:2]
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(x, 0.05), k) for k, x in enumerate(d, 1)]


def _by_model(values: dict) -> Column:
    """The value of the row's model."""
    return F.element_at(F.create_map(*(x for m, v in values.items() for x in (F.lit(m), v))), F.col("m"))


def train(texts: DataFrame, folds: int = FOLDS) -> tuple[DataFrame, dict[int, float]]:
    """The models as (m, k, g, w) rows, and by model the floor that every symbol starts from.

    Of texts (text, fold), model `m` has counted all outside fold `m`, and model `folds` all. The models go
    through the same joins, so their number adds rows to a job but no jobs.
    """
    counts = {ORDER: materialize(gram_counts(texts, folds))}
    for k in range(ORDER - 1, 0, -1):  # in how many left contexts a shorter gram was seen
        shorter = F.col("g").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("g")
        counts[k] = materialize(counts[k + 1].select("m", shorter).groupBy("m", "g").agg(F.count(F.lit(1)).alias("c")))
    every = reduce(DataFrame.unionByName, (counts[k].select("m", F.lit(k).alias("k"), "c") for k in counts))
    seen_so = [F.sum((F.col("c") == n).cast("long")).alias(f"n{n}") for n in (1, 2, 3, 4)]
    sizes = every.groupBy("m", "k").agg(*seen_so, F.count(F.lit(1)).alias("grams"), F.sum("c").alias("total"))
    discounts, floors, totals = defaultdict(dict), {}, {}
    for r in sizes.collect():  # a row per model and order
        n = [r.n1, r.n2, r.n3, r.n4]
        d = discounts[r.k][r.m] = _discounts(n)
        if r.k == 1:
            gamma = (d[0] * n[0] + d[1] * n[1] + d[2] * (r.grams - n[0] - n[1])) / r.total
            floors[r.m], totals[r.m] = math.log(max(gamma, 1e-12) / (r.grams + 1)), r.total
    if not floors:
        return counts[1].select("m", F.lit(1).alias("k"), "g", F.lit(0.0).alias("w")), {}
    floor = _by_model({m: F.lit(x) for m, x in floors.items()})
    below, weights = None, []
    for k in range(1, ORDER + 1):
        d = _by_model({m: F.array(*map(F.lit, x)) for m, x in discounts[k].items()})
        rows = counts[k].withColumn("d", F.element_at(d, F.least("c", F.lit(3)).cast("int")))
        if k == 1:
            seen = (F.col("c") - F.col("d")) / _by_model({m: F.lit(x) for m, x in totals.items()})
            below = rows.select("m", "g", F.log(seen + F.exp(floor)).alias("lp"))
            weights.append(below.select("m", F.lit(1).alias("k"), "g", (F.col("lp") - floor).alias("w")))
        else:
            rows = rows.withColumn("h", F.shiftrightunsigned("g", 16))
            contexts = rows.groupBy("m", "h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
            tail = F.col("g").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1))
            lower = below.select("m", F.col("g").alias("t"), F.col("lp").alias("lower"))
            back = F.log("gamma") + F.col("lower")
            seen = (F.col("c") - F.col("d")) / F.col("total")
            scored = rows.join(contexts, ["m", "h"]).withColumn("t", tail).join(lower, ["m", "t"]).withColumn("lp", F.log(seen + F.exp(back)))
            weights.append(scored.select("m", F.lit(k).alias("k"), "g", (F.col("lp") - back).alias("w")))
            weights.append(contexts.select("m", F.lit(k - 1).alias("k"), F.col("h").alias("g"), F.log("gamma").alias("w")))
            below = materialize(scored.select("m", "g", "lp")) if k < ORDER else None
    model = reduce(DataFrame.unionByName, weights)
    return materialize(model.groupBy("m", "k", "g").agg(F.sum("w").alias("w"))), floors


class Shard:
    """Some rows of the models, by model and order and sorted by gram."""

    def __init__(self, table: pa.Table):
        model, order, gram, weight = (table.column(c).to_numpy() for c in ("m", "k", "g", "w"))
        self.orders = {}
        for m in np.unique(model).tolist():
            for k in range(1, ORDER + 1):
                own = np.flatnonzero((model == m) & (order == k))
                keys = gram[own].astype(np.int64).view(np.uint64)
                by = np.argsort(keys)
                self.orders[m, k] = (keys[by], weight[own][by])

    def _weights(self, m: int, k: int, grams: np.ndarray) -> np.ndarray:
        keys, w = self.orders.get((m, k), ((), ()))
        if not len(keys):
            return np.zeros(len(grams))
        spot = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return np.where(keys[spot] == grams, w[spot], 0.0)

    def start(self, m: int) -> float:
        """What the contexts before the first symbol add."""
        gram, total = 0, 0.0
        for k in range(1, ORDER):
            gram = (gram << 16) | _START
            total += float(self._weights(m, k, np.array([gram], dtype=np.uint64))[0])
        return total

    def sums(self, m: int, gram: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        values, inverse = np.unique(gram, return_inverse=True)
        total = self._weights(m, ORDER, values)
        for k in range(1, ORDER):
            total += self._weights(m, k, values & np.uint64((1 << (16 * k)) - 1))
        return np.bincount(row, weights=total[inverse], minlength=rows)


def _scores(batches, shard: Shard):
    for batch in batches:
        judges = batch.column("m").to_numpy()
        for at, rows, gram, row in _runs(batch.column("text")):
            judge = judges[at : at + rows]
            logp = np.zeros(rows)
            for m in np.unique(judge).tolist():
                own = judge[row] == m
                logp += shard.sums(m, gram[own], row[own], rows) + np.where(judge == m, shard.start(m), 0.0)
            n = np.bincount(row, minlength=rows)
            kept = [batch.column(c).slice(at, rows) for c in ("doc_id", "lang", "m", "key")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n), pa.array(logp)], ["doc_id", "lang", "m", "key", "n", "part"])


def perplexities(docs: DataFrame, model: DataFrame, floors: dict[int, float]) -> DataFrame:
    """(doc_id, lang, m, perplexity) of every row under the model `m` it names; null and empty texts hold the end symbol alone."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("m").cast("int").alias("m"), F.coalesce("text", F.lit("")).alias("text"),
    )
    size = model.count()
    shards = max(1, -(-size // SHARD_ROWS))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    parts = None
    for at in range(shards):
        # a shard holds about SHARD_ROWS hashed rows of four numbers
        own = model.where(F.pmod(F.xxhash64("k", "g"), F.lit(shards)) == at).toArrow()
        shard = spark.sparkContext.broadcast(Shard(own))
        part = rows.mapInArrow(
            lambda batches, shard=shard: _scores(batches, shard.value),
            "doc_id bigint, lang string, m int, key bigint, n bigint, part double",
        )
        parts = part if parts is None else parts.unionByName(part)
    if shards > 1:  # rows equal in id, language and text stay as many as they were
        parts = parts.groupBy("doc_id", "lang", "m", "key", "n").agg(
            (F.sum("part") * shards / F.count(F.lit(1))).alias("part"), (F.count(F.lit(1)) / shards).cast("int").alias("copies")
        )
        parts = parts.select("doc_id", "lang", "m", "n", "part", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_c"))
    floor = F.coalesce(_by_model({m: F.lit(x) for m, x in floors.items()}), F.lit(0.0)) if floors else F.lit(0.0)  # no text, no symbols
    return parts.select("doc_id", "lang", "m", F.exp(-(F.col("part") / F.col("n") + floor)).alias("perplexity"))


def language_limits(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, limit): the perplexity up to which the given share of a language's rows lie, on a grid."""
    cell = F.round(F.log("perplexity") * GRID).cast("long")
    counts = scored.groupBy("lang", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy("lang").orderBy("cell")  # one row per grid cell
    share = F.sum("c").over(order) / F.sum("c").over(W.partitionBy("lang"))
    reached = counts.withColumn("share", share).where(F.col("share") >= quantile)
    return reached.groupBy("lang").agg(F.exp((F.min("cell") + 0.5) / GRID).alias("limit"))


def dealt(texts: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Adds `fold`; equal texts share one, so none is judged by its own copy."""
    return texts.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int"))


def quality_report(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, perplexity, kept): every row against the limit that trusted text of its language sets.

    Trusted are the documents labelled of good quality. The model counts all of them; the limit is a
    quantile of what they get from models that have not seen them, so that unseen good text passes
    as they do. A language without trusted text, the null language included, uses the limit of all
    trusted text; without any trusted text all are kept.
    """
    good = materialize(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct())
    if good.count() <= BROADCAST_IDS:  # else Spark picks the join
        good = F.broadcast(good)
    trusted = dealt(docs.join(good, F.col("doc_id") == F.col("_good"), "left_semi"))
    models, floors = train(trusted)
    own = ["doc_id", "lang", "text"]
    asked = docs.select(*own, F.lit(FOLDS).alias("m")).unionByName(trusted.select(*own, F.col("fold").alias("m")))
    judged = materialize(perplexities(asked, models, floors))
    scored, known = judged.where(F.col("m") == FOLDS), judged.where(F.col("m") < FOLDS)
    limits = language_limits(known, quantile).select(F.col("lang").alias("_lang"), "limit")
    overall = language_limits(known.withColumn("lang", F.lit("all")), quantile).select(F.col("limit").alias("_any"))
    both = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(overall), how="left")
    limit = F.coalesce("limit", "_any", F.lit(float("inf")))
    return both.select("doc_id", "perplexity", limit.alias("limit"), (F.col("perplexity") <= limit).alias("kept"))
