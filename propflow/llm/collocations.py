"""Collocations of each language, mined by partitioning.

The documents are dealt to a few shards. Each shard is mined completely, level by level, at a
support lowered to its share of the language's words: a phrase frequent in the language is frequent
in at least one shard, so the union of what the shards find holds all of them. Then all of those,
and only those, are counted over every document.

A level's phrases travel as 64-bit hashes and are remembered in a bitmap, where unlike phrases may
share a bit; that can only let more phrases through to the last count, which goes by the phrases
themselves and is exact.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from propflow.llm.bits import Bits, bitmap
from propflow.llm.hashing import mix, prefix_sums, span_hashes, text_slices
from propflow.session import materialize

SHARDS = 4
SUPPORT = 10
MOST_WORDS = 3
INSIDE_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
POOL = 2 << 20  # phrases counted at a time in a task
BATCH = 1 << 16  # rows handed over at a time
LEAST_BITS = 16  # of a bitmap, as a power of two
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, dtype=bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SOLID = ~_CUT
_SOLID[[0x20, 0x09]] = False


@lru_cache(None)
def _salt(*names: object) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(repr(names).encode(), digest_size=8).digest(), "little"))


class Run:
    """The words of some texts, each text ending in a cut, side by side with one blank after each word."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, most_words: int):
        solid = _SOLID[data]
        follows = np.zeros(len(data), dtype=bool)
        follows[1:] = solid[:-1] & ~solid[1:]
        cuts = np.concatenate([[0], np.cumsum(_CUT[data])])
        starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]])) if len(data) else np.zeros(0, dtype=np.int64)
        ends = np.flatnonzero(follows)
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        self.text = np.where(solid, _LOWER[data], np.uint8(0x20))[solid | follows]
        self.ends = np.flatnonzero(self.text == 0x20)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64) if len(self.ends) else self.ends
        joined = cuts[starts[1:]] == cuts[ends[:-1]]  # no cut between a word and the next
        self.whole = [np.ones(len(starts), dtype=bool)]  # whether a phrase of k + 1 words starts at each word
        for _ in range(1, most_words):
            last = self.whole[-1]
            reach = len(self.whole)
            more = np.zeros(len(starts), dtype=bool)
            if len(starts) > reach:
                more[:-reach] = last[:-reach] & joined[reach - 1 :]
            self.whole.append(more)
        self.sums = prefix_sums(self.text)

    def hashes(self, at: np.ndarray, words: int, salts: np.ndarray) -> np.ndarray:
        """Keys of the phrases of `words` words from the words `at`, `salts` by row."""
        return mix(span_hashes(self.sums, self.starts[at], self.ends[at + words - 1]) ^ salts[self.row[at]])

    def phrases(self, at: np.ndarray, words: int) -> pa.Array:
        first, last = self.starts[at], self.ends[at + words - 1]
        size = last - first
        offsets = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])
        data = pa.py_buffer(self.text[take].tobytes())
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64).tobytes()), data).cast(pa.string())


def _runs(batch: pa.RecordBatch, most_words: int):
    """(run, salt of each row's language, salt of its shard, first row, rows)."""
    langs, shards = batch.column("lang").to_pylist(), batch.column("shard").to_pylist()
    for at, offsets, data in text_slices(batch.column("text")):
        rows = len(offsets) - 1
        own = langs[at : at + rows]
        by_lang = np.array([_salt(x) for x in own], dtype=np.uint64)
        by_shard = np.array([_salt(x, s) for x, s in zip(own, shards[at : at + rows], strict=True)], dtype=np.uint64)
        yield Run(offsets, data, most_words), by_lang, by_shard, own, shards[at : at + rows]


def _local(batches, words: int, shorter: Bits | None):
    """(grp, key, c) of one length per shard and language; beside them (lang, shard, grp, words) totals of single words."""
    pool, held, totals = defaultdict(list), 0, defaultdict(int)

    def rows(lang, shard, grp, key, c):
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.array(lang, pa.string()), "shard": pa.array(shard, pa.int32()),
                "grp": pa.array(grp, pa.int64()), "key": pa.array(key, pa.int64()), "c": pa.array(c, pa.int64()),
            }
        )

    def counted():
        for grp, keys in pool.items():
            every = np.concatenate(keys)
            keys.clear()
            every.sort()
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            values, counts = every[first], np.diff(np.append(first, len(every)))
            for at in range(0, len(values), BATCH):
                own = values[at : at + BATCH].view(np.int64)
                yield rows(pa.nulls(len(own)), pa.nulls(len(own)), np.full(len(own), grp).view(np.int64), own, counts[at : at + BATCH])

    for batch in batches:
        for run, by_lang, by_shard, langs, shards in _runs(batch, words):
            at = np.flatnonzero(run.whole[words - 1])
            if shorter is not None:
                for step in (0, 1):
                    at = at[shorter.has(run.hashes(at + step, words - 1, by_lang) ^ by_shard[run.row[at]])]
            keys, grp = run.hashes(at, words, by_lang), by_shard[run.row[at]]
            order = np.argsort(grp, kind="stable")
            names, first = np.unique(grp[order], return_index=True)
            for name, own in zip(names, np.split(keys[order], first[1:]), strict=True) if len(at) else ():
                pool[name].append(own)
            held += len(at)
            if shorter is None:
                counts = np.bincount(run.row, minlength=len(langs))
                for lang, shard, n in zip(langs, shards, counts, strict=True):
                    totals[lang, shard] += int(n)
            if held >= POOL:
                yield from counted()
                pool, held = defaultdict(list), 0
    yield from counted()
    if totals:
        lang, shard = zip(*totals, strict=True)
        grp = [int(_salt(*x).view(np.int64)) for x in totals]
        yield rows(lang, shard, grp, pa.nulls(len(lang)), list(totals.values()))


def _frequent(mined: DataFrame, supports: DataFrame) -> DataFrame:
    """(grp, key) of the phrases that reach their shard's support.

    Tasks have counted what they hold; the rest differs from task to task, so it moves as it is.
    """
    counts = mined.select("grp", "key", "c").repartition("grp", "key").groupBy("grp", "key").agg(F.sum("c").alias("c"))
    return counts.join(supports, "grp").where("c >= support").select("grp", "key")


def _level(docs: DataFrame, words: int, shorter: DataFrame | None) -> DataFrame:
    """What the tasks count of phrases of one length, those only whose shorter parts are frequent in the shard."""
    bits = None
    if shorter is not None:
        bits = docs.sparkSession.sparkContext.broadcast(bitmap(shorter.select(F.col("grp").bitwiseXOR(F.col("key")).alias("h")), LEAST_BITS))
    return docs.mapInArrow(
        lambda batches: _local(batches, words, bits and bits.value), "lang string, shard int, grp bigint, key bigint, c bigint"
    )


def _occurrences(batches, most_words: int, wanted: Bits):
    """(lang, phrase, words, f) of the phrases in `wanted`, counted by their text."""
    pool, held = [], 0

    def counted():
        table = pa.concat_tables(pool).group_by(["lang", "phrase", "words"]).aggregate([("f", "sum")])
        return table.select(["lang", "phrase", "words", "f_sum"]).rename_columns(["lang", "phrase", "words", "f"]).to_batches()

    for batch in batches:
        for run, by_lang, _, langs, _ in _runs(batch, most_words):
            names, index = np.unique(np.array(langs, dtype=object), return_inverse=True)
            for words in range(1, most_words + 1):
                at = np.flatnonzero(run.whole[words - 1])
                at = at[wanted.has(run.hashes(at, words, by_lang))]
                if len(at):
                    lang = pa.DictionaryArray.from_arrays(pa.array(index[run.row[at]].astype(np.int32)), pa.array(names, pa.string()))
                    part = pa.table({"lang": lang.cast(pa.string()), "phrase": run.phrases(at, words)}).group_by(["lang", "phrase"])
                    part = part.aggregate([([], "count_all")]).rename_columns({"count_all": "f"})
                    pool.append(part.append_column("words", pa.array([words] * len(part), pa.int32())))
                    held += len(part)
            if held >= POOL // 4:
                yield from counted()
                pool, held = [], 0
    if pool:
        yield from counted()


def phrase_counts(
    docs: DataFrame, support: int = SUPPORT, most_words: int = MOST_WORDS, shards: int = SHARDS
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases and words with f >= support, (lang, n) words of each language).

    docs is (doc_id, text, lang); see `collocations` for what a phrase is.
    """
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text")
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), shard, text)
    mined = materialize(_level(rows, 1, None))
    sizes = mined.where("lang is not null").groupBy("lang", "shard", "grp").agg(F.sum("c").alias("n"))
    totals = sizes.groupBy("lang").agg(F.sum("n").alias("n"))
    whole = totals.select(F.col("lang").alias("_lang"), F.col("n").alias("_n"))
    # the least count c with c / n of the shard >= support / n of the language, in whole numbers
    lowered = F.expr(f"cast(({support} * cast(n as decimal(19, 0)) + _n - 1) div greatest(_n, 1) as bigint)")
    supports = sizes.where("n > 0").join(whole, F.col("lang") == F.col("_lang")).select("grp", lowered.alias("support"))
    supports = materialize(supports)
    found = materialize(_frequent(mined.where("lang is null"), supports))
    union = found.select("key")
    for words in range(2, most_words + 1):
        found = materialize(_frequent(_level(rows, words, found), supports))
        union = union.unionByName(found.select("key"))
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap(union.distinct().select(F.col("key").alias("h")), LEAST_BITS))
    counts = rows.mapInArrow(
        lambda batches: _occurrences(batches, most_words, wanted.value), "lang string, phrase string, words int, f bigint"
    )
    counts = counts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= support)
    return materialize(counts), totals


def collocations(
    docs: DataFrame,
    support: int = SUPPORT,
    most_words: int = MOST_WORDS,
    inside_percent: int = INSIDE_PERCENT,
    top: int = TOP,
    shards: int = SHARDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of docs (doc_id, text, lang).

    Words are runs of bytes other than blank and tab, lower-cased from A to Z, in pieces cut at
    `.,;:!?` and line ends; phrases are two to `most_words` words in a row within a piece. A phrase
    found `support` times is a candidate; its score is the least over its cuts of
    floor(1000000 * a * a / (l * r)), equal ones by the earliest cut. Candidates inside a longer one
    with at least `inside_percent` of their count are dropped. Equal scores go by count, then phrase.

    Null texts are empty, a null language is `und`, null ids and repeated rows count like any others,
    empty tables give no rows, other columns are ignored, texts of any length are read whole. Counts
    up to 10 ** 15 are exact.
    """
    counts, totals = phrase_counts(docs.select("doc_id", "text", "lang"), support, most_words, shards)
    longer = counts.where("words >= 2").withColumnRenamed("f", "a")
    parts = F.split("phrase", " ")
    cuts = longer.select("lang", "phrase", "a", parts.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut")), " ").alias("right"),
    )
    for side, out in (("left", "l"), ("right", "r")):
        part = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(out))
        cuts = cuts.join(part, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))).drop("_lang", "_part")
    exact = "cast({0} as decimal(16, 0)) * cast({1} as decimal(16, 0))"
    score = F.expr(f"cast(({exact.format('a', 'a')} * {SCALE}) div ({exact.format('l', 'r')}) as bigint)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = F.transform(
        F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.struct(i.alias("i"), k.alias("k"))))),
        lambda x: F.array_join(F.slice("w", x["i"], x["k"]), " "),
    )
    inside = longer.where("words >= 3").withColumn("w", parts).select(F.col("lang").alias("_lang"), F.explode(inner).alias("_part"), "a")
    inside = inside.groupBy("_lang", "_part").agg(F.max("a").alias("_longer"))
    held = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part"))
    free = scored.join(inside, held & (100 * F.col("_longer") >= inside_percent * F.col("a")), "left_anti")
    order = W.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("a").desc(), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations_sql(
    support: int = SUPPORT, most_words: int = MOST_WORDS, inside_percent: int = INSIDE_PERCENT, top: int = TOP
) -> str:
    """The same as DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lengths = ", ".join(map(str, range(1, most_words + 1)))
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t
  FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([{lengths}]) AS k) WHERE len(w) >= k),
counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL HAVING f >= {support}),
cuts AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM counts WHERE k >= 2),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, c.cut, x.f AS l, y.f AS r,
    CAST(({SCALE}::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
free AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM counts o WHERE o.lang = b.lang AND o.k > b.k AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')
      AND 100 * o.f >= {inside_percent} * b.a)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}
"""
