"""Language of a text by interpolated Kneser-Ney models of characters, one per language.

Each language's model counts its four-symbol grams over all of its learning texts. A text's log
chance under a language is a sum of one weight per gram and order, because

    log p(w | h) = floor + sum over k of  log gamma(h_k) + [log p_k - log gamma(h_k) - log p_(k-1)]

and what a language has not seen adds nothing. The weights of all languages lie in one table; up to
`MODEL_ROWS` of them travel to the tasks as arrays sorted by hash, beyond that the texts' gram counts
are joined with the table. Limits and confidences come from learning texts that no model has counted.

Symbols are lower-cased letters and marks; whatever lies between is one boundary. Letters beyond 16
bits are folded to 16 by a hash, so that four symbols are one 64-bit number.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propflow.llm.hashing import SLICE_BYTES, mix
from propflow.session import materialize

ORDER = 4
POOL = 4 << 20  # grams counted at a time in a task
MODEL_ROWS = 4 << 20  # weights that travel to the tasks: 14 bytes each at most
QUANTILE = 0.995  # of the calibration texts of a language and length lie below its limit
LEAST_CALIBRATION = 100  # texts of a language and length, else the language's limit holds
LENGTHS = 12  # classes of length, by powers of two
MARGIN_CELLS = 96
UNKNOWN = "und"
_BOUNDARY, _START, _END, _FIRST = 1, 2, 3, 4


@lru_cache(1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its 16-bit symbol (0 outside letters and marks) and whether it is a letter."""
    symbol, letter = np.zeros(0x110000, dtype=np.uint16), np.zeros(0x110000, dtype=bool)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LM":
            low = ord(chr(point).lower()[0])
            symbol[point] = low if low < 0x10000 else _FIRST + (low * 0x9E3779B1 >> 8) % (0x10000 - _FIRST)
            letter[point] = kind == "L"
    return symbol, letter


def gram_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, grams by place, row of each, rows with a letter) for runs of texts."""
    symbol, letter = _alphabet()
    texts = [t or "" for t in column.to_pylist()]
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SLICE_BYTES):
            size += len(texts[stop])
            stop += 1
        run = texts[at:stop]
        codes = np.frombuffer("".join(run).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.repeat(np.arange(len(run)), [len(t) for t in run])
        found = symbol[codes]
        gap = found == 0
        after_gap = np.ones(len(gap), dtype=bool)
        after_gap[1:] = gap[:-1] | (row[1:] != row[:-1])
        kept = ~(gap & after_gap)
        codes_kept, row_kept = np.where(gap, _BOUNDARY, found)[kept], row[kept]
        n = np.bincount(row_kept, minlength=len(run))
        first = np.concatenate([[0], np.cumsum(n + ORDER)])
        stream = np.full(first[-1], _START, dtype=np.uint64)
        place = np.arange(len(row_kept)) - np.concatenate([[0], np.cumsum(n)])[row_kept]
        stream[first[row_kept] + ORDER - 1 + place] = codes_kept
        stream[first[1:] - 1] = _END
        gram = np.zeros(len(stream) - ORDER + 1, dtype=np.uint64)
        for k in range(ORDER):
            gram = (gram << np.uint64(16)) | stream[k : k + len(gram)]
        owner = np.repeat(np.arange(len(run)), n + ORDER)
        whole = owner[: len(gram)] == owner[ORDER - 1 :]
        lettered = np.bincount(row[letter[codes]], minlength=len(run)) > 0
        yield at, stop - at, gram[whole], owner[: len(gram)][whole], lettered
        at = stop


def _counted(batches):
    pool, held = defaultdict(list), 0

    def counted():
        for lang, grams in sorted(pool.items()):
            values, counts = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(values)), "g": values.view(np.int64), "c": counts.astype(np.int64)}
            )

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for at, rows, gram, row, lettered in gram_runs(batch.column("text")):
            names, index = np.unique(np.array(langs[at : at + rows], dtype=object), return_inverse=True)
            index = np.where(lettered, index, -1)[row]
            for i, lang in enumerate(names):
                own = gram[index == i]
                if len(own):
                    pool[lang].append(own)
                    held += len(own)
        if held >= POOL:
            yield from counted()
            pool, held = defaultdict(list), 0
    yield from counted()


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, g, c): how often each language's texts hold each gram of the highest order."""
    rows = texts.where("lang is not null").select("lang", "text").mapInArrow(_counted, "lang string, g bigint, c bigint")
    return rows.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _by_lang(values: dict[str, float]) -> Column:
    """The value of the row's language."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("lang"))


def _discounts(counts: DataFrame) -> dict[str, float]:
    """Each language's n1 / (n1 + 2 n2) of the grams seen once and twice."""
    n1, n2 = (F.sum((F.col("c") == k).cast("double")) for k in (1, 2))
    share = F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(0.5)
    return {r.lang: r.d for r in counts.groupBy("lang").agg(share.alias("d")).collect()}  # a number per language


def train(texts: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """The models of all languages: weights (k, g, lang, w), and by language the floor that every symbol starts from.

    Texts without a letter and rows without a language teach nothing.
    """
    counts = {ORDER: materialize(gram_counts(texts))}
    for k in range(ORDER - 1, 0, -1):  # after how many different symbols a shorter gram was seen
        shorter = F.col("g").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("g")
        counts[k] = materialize(counts[k + 1].select("lang", shorter).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("c")))
    symbols = counts[1].select("g").distinct().count()
    if not symbols:
        return counts[1].select(F.lit(1).alias("k"), "g", "lang", F.lit(0.0).alias("w")), {}
    weights, below, floors = [], None, {}
    for k in range(1, ORDER + 1):
        context = F.shiftrightunsigned("g", 16) if k > 1 else F.lit(0).cast("long")
        rows = counts[k].withColumns({"d": _by_lang(_discounts(counts[k])), "h": context})
        contexts = rows.groupBy("lang", "h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        rows = rows.join(contexts, ["lang", "h"])
        seen = (F.col("c") - F.col("d")) / F.col("total")
        if k == 1:
            floors = {r.lang: math.log(r.gamma / (symbols + 1)) for r in contexts.select("lang", "gamma").collect()}
            below = materialize(rows.select("lang", "g", F.log(seen + F.exp(_by_lang(floors))).alias("lp")))
            weights.append(below.select(F.lit(1).alias("k"), "g", "lang", (F.col("lp") - _by_lang(floors)).alias("w")))
        else:
            tail = F.col("g").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1))
            lower = below.select("lang", F.col("g").alias("t"), F.col("lp").alias("lower"))
            back = F.log("gamma") + F.col("lower")
            scored = rows.withColumn("t", tail).join(lower, ["lang", "t"]).withColumn("lp", F.log(seen + F.exp(back)))
            weights.append(scored.select(F.lit(k).alias("k"), "g", "lang", (F.col("lp") - back).alias("w")))
            weights.append(contexts.select(F.lit(k - 1).alias("k"), F.col("h").alias("g"), "lang", F.log("gamma").alias("w")))
            below = materialize(scored.select("lang", "g", "lp")) if k < ORDER else None
    model = weights[0]
    for part in weights[1:]:
        model = model.unionByName(part)
    return materialize(model.groupBy("k", "g", "lang").agg(F.sum("w").alias("w"))), floors


class Weights:
    """Per order, the grams' hashes in order with the languages and weights of each."""

    def __init__(self, table: pa.Table, langs: list[str]):
        self.langs = len(langs)
        index = {lang: i for i, lang in enumerate(langs)}
        order, gram, weight = (table.column(c).to_numpy() for c in ("k", "g", "w"))
        lang = np.array([index[x] for x in table.column("lang").to_pylist()], dtype=np.int16)
        self.orders = {}
        for k in range(1, ORDER + 1):
            own = np.flatnonzero(order == k)
            hashed = mix(gram[own].astype(np.int64).view(np.uint64))
            by = np.argsort(hashed, kind="stable")
            keys, first = np.unique(hashed[by], return_index=True)
            self.orders[k] = (keys, np.append(first, len(own)), lang[own][by], weight[own][by].astype(np.float32))

    def of(self, k: int, grams: np.ndarray) -> np.ndarray:
        """A row of weights, one per language, for each gram of `k` symbols."""
        keys, first, lang, weight = self.orders[k]
        out = np.zeros(len(grams) * self.langs)
        if len(keys):
            hashed = mix(grams)
            spot = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            hit = np.flatnonzero(keys[spot] == hashed)
            begin, size = first[spot[hit]], first[spot[hit] + 1] - first[spot[hit]]
            place = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(hit) else begin
            out[np.repeat(hit, size) * self.langs + lang[place]] = weight[place]
        return out.reshape(len(grams), self.langs)

    def start(self) -> np.ndarray:
        """What the contexts before the first symbol add."""
        return sum(self.of(k, np.array([_start_gram(k)], dtype=np.uint64))[0] for k in range(1, ORDER))

    def sums(self, gram: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        values, inverse = np.unique(gram, return_inverse=True)
        total = self.of(ORDER, values)
        for k in range(1, ORDER):
            short, back = np.unique(values & np.uint64((1 << (16 * k)) - 1), return_inverse=True)
            total += self.of(k, short)[back]
        return np.stack([np.bincount(row, weights=total[inverse, i], minlength=rows) for i in range(self.langs)], axis=1)


def _start_gram(k: int) -> int:
    return sum(_START << (16 * i) for i in range(k))


def _sums_in_task(batches, weights: Weights, own: list[str]):
    start = weights.start()
    for batch in batches:
        for at, rows, gram, row, lettered in gram_runs(batch.column("text")):
            n = np.where(lettered, np.bincount(row, minlength=rows), 0)
            sums = weights.sums(gram, row, rows) + start
            flat = pa.array(sums.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * weights.langs), flat)
            columns = [batch.column(c).slice(at, rows) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), lists], [*own, "n", "sums"])


def _texts_counted(batches):
    for batch in batches:
        for at, rows, gram, row, lettered in gram_runs(batch.column("text")):
            order = np.lexsort((gram, row))
            gram, row = gram[order], row[order]
            new = np.ones(len(gram), dtype=bool)
            new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            key = batch.column("key").slice(at, rows).take(pa.array(row[first]))
            c = np.diff(np.append(first, len(gram)))
            n = np.where(lettered, np.bincount(row, minlength=rows), 0)[row[first]]
            yield pa.RecordBatch.from_arrays(
                [key, pa.array(n.astype(np.int64)), pa.array(gram[first].view(np.int64)), pa.array(c.astype(np.int64))],
                ["key", "n", "g", "c"],
            )


def _sums_by_join(texts: DataFrame, model: DataFrame, langs: list[str]) -> DataFrame:
    """(key, n, sums) of distinct texts (key, text), the model never leaving its table."""
    counts = texts.mapInArrow(_texts_counted, "key binary, n bigint, g bigint, c bigint")
    shorter = [F.col("g").bitwiseAND(F.lit((1 << (16 * k)) - 1)) for k in range(1, ORDER)]
    ranks = F.array(*(F.struct(F.lit(k).alias("k"), g.alias("g")) for k, g in enumerate([*shorter, F.col("g")], 1)))
    long = counts.select("key", "n", "c", F.inline(ranks)).groupBy("key", "n", "k", "g").agg(F.sum("c").alias("c"))
    found = long.join(model, ["k", "g"], "left").groupBy("key", "n", "lang").agg(F.sum(F.col("c") * F.col("w")).alias("s"))
    per = F.map_from_entries(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "s"))))  # one entry per language
    starts = {k: _start_gram(k) for k in range(1, ORDER)}
    hit = " OR ".join(f"(k = {k} AND g = {g})" for k, g in starts.items())
    start = {r.lang: r.w for r in model.where(hit).groupBy("lang").agg(F.sum("w").alias("w")).collect()}
    total = [F.coalesce(F.col("per")[lang], F.lit(0.0)) + F.lit(start.get(lang, 0.0)) for lang in langs]
    return found.groupBy("key", "n").agg(per.alias("per")).select("key", "n", F.array(*total).alias("sums"))


def language_sums(rows: DataFrame, model: DataFrame, langs: list[str], model_rows: int = MODEL_ROWS) -> DataFrame:
    """`rows` (with `text`) with `n`, its symbols (0 without a letter), and `sums`, one per language, in place of the text."""
    own = [c for c in rows.columns if c != "text"]
    if model.count() <= model_rows:
        weights = rows.sparkSession.sparkContext.broadcast(Weights(model.toArrow(), langs))
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)
        return rows.mapInArrow(
            lambda batches: _sums_in_task(batches, weights.value, own), f"{kinds}, n bigint, sums array<double>"
        )
    keyed = rows.withColumn("key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    texts = keyed.groupBy("key").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    return keyed.drop("text").join(_sums_by_join(texts, model, langs), "key").drop("key")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null without an id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _calibrates(doc_id: Column) -> Column:
    """A tenth of the ids of each fold."""
    return F.pmod(F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 5), F.lit(10)) == 0


def _limits(rows: DataFrame, keys: list[str], quantile: float, least: int, out: str) -> DataFrame:
    """Per key, the entropy below which the given share of rows lies, on a grid of a thousandth."""
    cells = rows.groupBy(*keys, F.round(F.col("entropy") * 1000).cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    whole = W.partitionBy(*keys)  # a row per grid cell, however many texts lie in it
    upto = F.sum("c").over(whole.orderBy("cell"))
    held = cells.withColumns({"share": upto / F.sum("c").over(whole), "all": F.sum("c").over(whole)})
    held = held.where((F.col("share") >= quantile) & (F.col("all") >= least))
    return held.groupBy(*(F.col(k).alias(f"{out}_{k}") for k in keys)).agg(((F.min("cell") + 0.5) / 1000).alias(out))


def rising(cells: list[tuple[float, float]]) -> list[float]:
    """Share of hits in each (rows, hits) cell, neighbours pooled until it never falls; empty cells take the one below."""
    blocks: list[list[float]] = []
    for n, hits in cells:
        blocks.append([n, hits, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, hits, size = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + hits, blocks[-1][2] + size]
    return [(hits + 0.5) / (n + 1) for n, hits, size in blocks for _ in range(int(size))]


def predict_languages(docs: DataFrame, quantile: float = QUANTILE, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, accepted) of every row of docs (doc_id, text, lang).

    Learned from are rows with a language and an id outside fold 0; a tenth of them is kept from the
    counts for calibration. `lang_pred` has the least cross-entropy per symbol, equal ones by name;
    `und` for null texts and those without a letter (score 0), and for all where nothing could be
    learned. `score` is the share of right predictions among calibration texts whose first
    language lies as far ahead of the second (0.5 where there are none), and no more than the chance
    of the first language against the second. `accepted` tells whether the entropy lies
    within the limit of calibration texts of that language and length. A null id is in no fold: it is
    not learned from and not held out. Repeated rows are judged alike, each on its own row; texts are
    read whole; other columns are ignored.
    """
    key = F.col("doc_id")
    rows = docs.select(key.cast("long").alias("doc_id"), fold(key).alias("fold"), _calibrates(key).alias("aside"), "lang", "text")
    learning = (F.col("fold") != 0) & F.col("lang").isNotNull()
    model, floor = train(rows.where(learning & ~F.col("aside")))
    held_out = F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out")
    if not floor:
        nothing = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy")]
        return rows.select("doc_id", held_out, *nothing, F.lit(False).alias("accepted"))
    langs = sorted(floor)
    sums = language_sums(rows, model, langs, model_rows)
    chances = F.array(*(F.struct((F.col("sums")[i] + F.col("n") * floor[x]).alias("s"), F.lit(-i).alias("i")) for i, x in enumerate(langs)))
    best = F.sort_array(chances, asc=False)
    ranked = sums.withColumn("best", best).select(
        "doc_id", "fold", "lang", "n", (learning & F.col("aside") & (F.col("n") > 0)).alias("aside"),
        F.element_at(F.array(*map(F.lit, langs)), 1 - F.col("best")[0]["i"]).alias("guess"),
        F.when(F.col("n") > 0, -F.col("best")[0]["s"] / F.col("n")).alias("entropy"),
        (F.col("best")[0]["s"] - F.col("best")[1]["s"] if len(langs) > 1 else F.lit(math.inf)).alias("margin"),
    )
    cell = F.least(F.floor(F.log2(1 + F.col("margin")) * 6), F.lit(MARGIN_CELLS - 1)).cast("int")
    length = F.least(F.floor(F.log2(F.greatest("n", F.lit(1)))), F.lit(LENGTHS)).cast("int")
    scored = materialize(ranked.withColumns({"cell": cell, "length": length}))
    known = scored.where("aside")
    hits = known.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("guess") == F.col("lang")).cast("long")).alias("hits"))
    held = {r.cell: (r.n, r.hits) for r in hits.collect()}  # at most MARGIN_CELLS rows
    shares = rising([held.get(i, (0, 0)) for i in range(MARGIN_CELLS)])
    right = known.where("guess = lang")
    near = _limits(right, ["lang", "length"], quantile, LEAST_CALIBRATION, "near")
    wide = _limits(right, ["lang"], quantile, 1, "wide")
    both = scored.join(near, (F.col("guess") == F.col("near_lang")) & (F.col("length") == F.col("near_length")), "left")
    both = both.join(wide, F.col("guess") == F.col("wide_lang"), "left")
    limit = F.coalesce("near", "wide", F.lit(math.inf))
    lettered = F.col("n") > 0
    share = F.element_at(F.array(*map(F.lit, shares)), F.col("cell") + 1)
    return both.select(
        "doc_id", held_out, F.when(lettered, F.col("guess")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(lettered, F.least(share, 1 / (1 + F.exp(-F.col("margin"))))).otherwise(0.0).alias("score"),
        "entropy", F.coalesce(lettered & (F.col("entropy") <= limit), F.lit(False)).alias("accepted"),
    )
