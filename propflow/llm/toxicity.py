"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

Learning sees a bounded sample of labelled rows; scoring is one column expression over all texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from propflow.session import materialize

TRAIN_ROWS = 8_000  # labelled rows that are learned from, by smallest hash of the id
FLOOR_SHARE = 8  # one in so many of them is kept for an even share of each class and language
ENTRIES = 256  # stems in the learned lexicon
CANDIDATES = 4_000  # best stems looked at when the lexicon is drawn up
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
LEXICON_VOTERS = 12
WORD = r"\p{L}{3,}"


def fold(doc_id: Column) -> Column:
    """0 for held-out rows, 1 to 4 for rows to learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most `most` labelled ids outside the held-out fold, equal texts of an id once.

    Where more are labelled, each class of each language first gets an even part of a share of the
    places; the others go by hash, so the classes keep their proportions but for small groups.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 0)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if "lang" in docs.columns and marked.limit(most + 1).count() > most:
        langs = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"))
        marked = materialize(marked.join(langs, "doc_id"))
        groups = marked.select("toxic", "lang").distinct().count()
        floor = max(1, most // (FLOOR_SHARE * groups))
        place = F.row_number().over(W.partitionBy("toxic", "lang").orderBy(*order))
        few = marked.withColumn("_place", place).where(F.col("_place") <= floor).select("doc_id", F.lit(0).alias("turn"))
        marked = marked.join(few, "doc_id", "left")
        order = [F.coalesce("turn", F.lit(1)), *order]
    chosen = marked.orderBy(*order).limit(most).select("doc_id", "toxic")
    # `most` rows of two numbers
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.dropDuplicates(["doc_id", "text"]).select("text", "toxic")


def stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, pos, neg): toxic and other texts with a word that begins so."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0))
    heads = F.transform(words, lambda w: F.array_distinct(F.array(*(F.substring(w, 1, n) for n in STEM_LENGTHS))))
    stems = rows.select("toxic", F.explode(F.array_distinct(F.flatten(heads))).alias("stem"))
    return stems.groupBy("stem").agg(
        F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")
    )


def chance_evidence(pos: int, n: int, all_pos: int, rows: int) -> float:
    """Minus the log of the chance that at least `pos` of `n` texts drawn from all are toxic."""

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    ways = [log_choose(all_pos, k) + log_choose(rows - all_pos, n - k) for k in range(max(pos, n - rows + all_pos), min(n, all_pos) + 1)]
    top = max(ways)
    return max(0.0, log_choose(rows, n) - top - math.log(sum(math.exp(w - top) for w in ways)))


def evidence_bound(sizes: list[tuple[int, int]], all_pos: int, rows: int) -> float:
    """The evidence beyond which less than one stem is expected by chance, from (texts, stems) counts.

    A stem in few texts cannot reach it whatever its texts are, so only stems that could count as
    tried (Tarone): the bound falls with the number of stems and of toxic texts.
    """
    reach = sorted(((chance_evidence(min(n, all_pos), n, all_pos, rows), stems) for n, stems in sizes), reverse=True)
    tried = 0
    for evidence, stems in reach:
        if evidence < math.log(max(tried + stems, 1)):
            # this size is out: the bound lies above what it can reach
            return max(math.log(max(tried, 1)), math.nextafter(evidence, math.inf))
        tried += stems
    return math.log(max(tried, 1))


def learn_lexicon(rows: DataFrame, most: int = ENTRIES) -> list[str]:
    """Word beginnings that mark toxic texts, strongest first."""
    sizes = rows.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    if not sizes.pos or not sizes.neg:
        return []
    share = (F.col("pos") + 0.5) / (sizes.pos + 1.0)
    lift = share / ((F.col("neg") + 0.5) / (sizes.neg + 1.0))
    counts = materialize(stem_counts(rows).withColumn("lift", lift))
    n = (F.col("pos") + F.col("neg")).alias("n")
    total = sizes.pos + sizes.neg
    # one row for each number of texts, then for each pair of numbers: bounded by the sample
    bound = evidence_bound([tuple(r) for r in counts.groupBy(n).count().collect()], sizes.pos, total)
    pairs = counts.where("pos > 0 and lift >= 3").select("pos", "neg").distinct().collect()
    judged = [(r.pos, r.neg, chance_evidence(r.pos, r.pos + r.neg, sizes.pos, total)) for r in pairs]
    passed = [row for row in judged if row[2] >= bound]
    if not passed:
        return []
    table = rows.sparkSession.createDataFrame(passed, "pos bigint, neg bigint, evidence double")
    best = counts.where("lift >= 3").join(F.broadcast(table), ["pos", "neg"])
    best = best.orderBy(F.desc("evidence"), "stem").limit(CANDIDATES)
    found = {r.stem: r for r in best.collect()}
    kept = []
    for stem, row in found.items():
        shorter = [found[stem[:n]] for n in STEM_LENGTHS if n < len(stem) and stem[:n] in found]
        if not any(other.lift >= 0.8 * row.lift for other in shorter):
            kept.append(stem)
    return kept[:most]


def _trie_pattern(stems: list[str]) -> str:
    """A pattern for the longest stem at a word's beginning."""
    trie: dict = {}
    for stem in stems:
        node = trie
        for letter in stem:
            node = node.setdefault(letter, {})
        node[""] = {}

    def branch(node: dict) -> str:
        parts = [re.escape(letter) + branch(node[letter]) for letter in sorted(node) if letter]
        if not parts:
            return ""
        joined = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return f"(?:{joined})?" if "" in node else joined

    return rf"(?<!\p{{L}}){branch(trie)}" if stems else r"\A(?!\A)"


def _signals(text: Column, pattern: str) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [
        F.regexp_extract_all(F.lower(text), F.lit(pattern), 0).alias("hits"),
        F.length(text).alias("chars"),
        F.regexp_count(text, F.lit("[!?]{2,}")).alias("bangs"),
    ]


def _shape(hits: np.ndarray, distinct: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(hits), np.log1p(distinct), 100.0 * hits / (chars + 100.0)], axis=1)


def votes(hit: np.ndarray, shape: np.ndarray, bangs: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """One column per voter: 1 toxic, -1 clean, 0 no opinion.

    Lexicon voters share the stems among them; pattern voters look at how many different stems a
    text has, how dense they are, and at marks in a row; the last voter is the given label.
    """
    columns = [hit[:, g::LEXICON_VOTERS].any(axis=1).astype(int) for g in range(LEXICON_VOTERS)]
    distinct, density = np.expm1(shape[:, 1]), shape[:, 2]
    columns.append(np.where(distinct >= 2, 1, np.where(distinct == 0, -1, 0)))
    columns.append(np.where(density >= 0.15, 1, np.where(density == 0, -1, 0)))
    columns.append(np.where(distinct >= 4, 1, 0))
    columns.append(np.where((bangs >= 3) & (distinct >= 1), 1, 0))
    columns.append(np.where(toxic == 1, 1, -1))
    return np.stack(columns, axis=1)


@dataclass
class LabelModel:
    """What the generative model has learned: class share, vote chances (voter, class, vote), voter weights."""

    share: float
    chances: np.ndarray
    weights: np.ndarray
    correlations: np.ndarray


def fit_label_model(vote: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation over two hidden classes; returns the model and each row's posterior.

    Voters are independent given the class but for pairwise correlations, measured on what their
    votes leave unexplained: a voter that repeats others counts for less.
    """
    n, voters = vote.shape
    kinds = np.stack([vote == v for v in (-1, 0, 1)], axis=2).astype(float)
    q = start.astype(float)
    for _ in range(rounds):
        by_class = np.stack([1 - q, q])
        chances = np.einsum("cn,njv->jcv", by_class, kinds) + 0.5
        chances /= chances.sum(axis=2, keepdims=True)
        share = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
        means = chances @ np.array([-1.0, 0.0, 1.0])
        rest = vote - by_class.T @ means.T
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        correlations = (rest.T @ rest) / n / np.outer(spread, spread)
        np.fill_diagonal(correlations, 0.0)
        # what few rows show by chance, within three standard errors, discounts no voter
        weights = 1.0 / (1.0 + np.where(correlations > 3.0 / np.sqrt(n), correlations, 0.0).sum(axis=1))
        odds = np.einsum("njv,jv->nj", kinds, np.log(chances[:, 1]) - np.log(chances[:, 0]))
        q = 1.0 / (1.0 + np.exp(-np.clip(odds @ weights + np.log(share / (1 - share)), -30, 30)))
    return LabelModel(share, chances, weights, correlations), q


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the first weight is the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (q - p) - penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        change = np.linalg.solve(hessian, gradient)
        w += change
        if np.abs(change).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    stems: list[str]
    bias: float
    stem_weights: list[float]
    shape_weights: list[float]
    label_model: LabelModel | None = None

    def score(self, text: Column) -> Column:
        """The chance that a text is toxic, from its words alone; null counts as empty."""
        if not self.stems:
            return F.lit(1.0 / (1.0 + float(np.exp(-self.bias))))
        hits, chars, _ = _signals(text, _trie_pattern(self.stems))
        table = F.map_from_arrays(
            F.array(*map(F.lit, self.stems)), F.array(*(F.lit(float(w)) for w in self.stem_weights))
        )
        a, b, c = (F.lit(float(w)) for w in self.shape_weights)

        def odds(s: Column) -> Column:
            n = F.size(s["hits"]).cast("double")
            own = F.array_distinct(s["hits"])
            words = F.aggregate(own, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(table, x), F.lit(0.0)))
            shape = a * F.log1p(n) + b * F.log1p(F.size(own).cast("double")) + c * 100.0 * n / (s["chars"] + 100.0)
            return F.when(n > 0, words + shape).otherwise(0.0) + F.lit(self.bias)

        signals = F.struct(hits, chars)
        value = F.element_at(F.transform(F.array(signals), odds), 1)
        return 1.0 / (1.0 + F.exp(-value))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> ToxicityModel:
    """A model from labelled rows outside the held-out fold; without both classes it scores a constant."""
    rows = training_rows(docs, labels, most)
    stems = learn_lexicon(rows)
    seen = rows.select("toxic", *_signals(F.col("text"), _trie_pattern(stems))).toPandas()  # `most` rows
    if not stems:
        share = (float(seen.toxic.sum()) + 0.5) / (len(seen) + 2.0)
        return ToxicityModel([], float(np.log(share / (1 - share))), [], [])
    place = {stem: i for i, stem in enumerate(stems)}
    hit = np.zeros((len(seen), len(stems)))
    for i, found in enumerate(seen.hits):
        hit[i, [place[s] for s in found if s in place]] = 1.0
    count = seen.hits.map(len).to_numpy(dtype=float)
    shape = _shape(count, hit.sum(axis=1), seen.chars.to_numpy(dtype=float))
    toxic = seen.toxic.to_numpy()
    vote = votes(hit, shape, seen.bangs.to_numpy(), toxic)
    model, posterior = fit_label_model(vote, np.where(toxic == 1, 0.9, 0.05))
    w = fit_linear(np.hstack([hit, shape]), posterior)
    return ToxicityModel(stems, float(w[0]), list(w[1 : 1 + len(stems)]), list(w[1 + len(stems) :]), model)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, repeated and null ones included."""
    model = train(docs, labels)
    scored = docs.select("doc_id", model.score(F.col("text")).cast("double").alias("score"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows scored below one half, all columns kept."""
    return docs.where(train(docs, labels).score(F.col("text")) < 0.5)
