"""Log-probability of multi-token categories from stored logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def log_total(logits: Column) -> Column:
    """The logarithm of the summed exponentials."""
    peak = F.array_max(logits)
    return peak + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - peak)))


def candidate_scores(
    rows: DataFrame,
    example: str,
    candidates: Column,
    values: str = "logits",
    pad_token: int | None = None,
    length_normalised: bool = False,
) -> DataFrame:
    """(example, category, logprob) of every candidate of every row's vector.

    `candidates` is an array of (category, ids). A vector is summed up once and stays in its row,
    however many candidates and tokens are read from it. Null and pad ids are left out, ids outside
    the vector add nothing; a candidate without ids has no row.
    """

    def scored(total: Column) -> Column:
        def score(candidate: Column) -> Column:
            kept = lambda t: t.isNotNull() if pad_token is None else t.isNotNull() & (t != pad_token)
            each = F.transform(F.filter(candidate["ids"], kept), lambda t: F.get(F.col(values), t) - total)
            known = F.filter(each, lambda x: x.isNotNull())
            whole = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
            logprob = F.when(F.size(known) > 0, whole / F.size(known) if length_normalised else whole)
            return F.struct(candidate["category"].alias("category"), logprob.alias("logprob"), F.size(each).alias("n"))

        return F.transform(candidates, score)

    # a lambda's argument is computed once, a column named in it may be computed again for every element
    once = F.flatten(F.transform(F.array(log_total(F.col(values))), scored))
    return rows.select(example, F.inline(once)).where("n > 0").select(example, "category", "logprob")


def token_logprob(logits: Column, token: Column) -> Column:
    """Log-softmax of the logits at a token id; null for an id outside them."""
    peak = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))
    return F.get(logits, token) - (peak + F.log(total))


def category_scores(
    logits: DataFrame,
    example: str,
    category: str,
    token: str = "token_id",
    values: str = "logits",
    pad_token: int | None = None,
    length_normalised: bool = False,
) -> DataFrame:
    """(example, category, logprob): summed over the category's tokens, pads left out."""
    rows = logits.where(F.col(token).isNotNull())
    if pad_token is not None:
        rows = rows.where(F.col(token) != pad_token)
    scored = rows.select(example, category, token_logprob(F.col(values), F.col(token)).alias("_lp"))
    total = F.avg("_lp") if length_normalised else F.sum("_lp")
    return scored.groupBy(example, category).agg(total.alias("logprob"))


def best_category(scores: DataFrame, example: str, category: str) -> DataFrame:
    """The category of highest log-probability per example, ties to the smallest name."""
    best = F.min_by(F.col(category), F.struct(-F.col("logprob"), F.col(category)))
    return scores.groupBy(example).agg(best.alias(category), F.max("logprob").alias("logprob"))
