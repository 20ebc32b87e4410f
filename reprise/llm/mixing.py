"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to a power, normalised. The power is found by bisection, so that the weights have
a wanted entropy or no source repeats more often than a limit within the budget. The weights are then realised: each
source is read in a fixed permutation, epoch after epoch, until its part of the budget is used, and every block of the
result takes the next stretch of every source in proportion, in an order permuted within the block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, whole_row

BUCKETS = 1 << 14
#: Up to so many sources the bisection has their shares on the driver and the table of weights is broadcast.
SOURCES_AT_ONCE = 10_000


class Shares:
    """What the bisection asks of the sources' shares at a power: entropy and repetition of the weights.

    A few sources are asked as an array, more as a table: one aggregation for each step.
    """

    def __init__(self, shares: np.ndarray | DataFrame):
        self.shares = shares

    def at(self, power: float) -> tuple[float, float, float, float]:
        """Sum of s**power, sum of s**power * log(s**power), least and largest s**(power-1)."""
        if isinstance(self.shares, np.ndarray):
            raw, per = self.shares**power, self.shares ** (power - 1)
            return raw.sum(), (raw * np.log(raw)).sum(), per.min(), per.max()
        raw, per = F.pow("share", F.lit(power)), F.pow("share", F.lit(power - 1))
        return tuple(self.shares.agg(F.sum(raw), F.sum(raw * F.log(raw)), F.min(per), F.max(per)).first())

    def entropy(self, power: float) -> float:
        total, logs, *_ = self.at(power)
        return math.log(total) - logs / total

    def repetition(self, power: float, covering: bool, scale: float = 1.0) -> float:
        """How often the most repeated source is read: with a covering budget every source is read at least once."""
        total, _, least, most = self.at(power)
        return most / least if covering else most / total * scale


def bisect_power(shares: Shares, target_entropy: float | None, most_repeats: float | None, covering: bool, scale: float = 1.0, rounds: int = 60) -> float:
    """The power in 0..1: the largest that reaches the entropy, or else the smallest that keeps to the limit.

    Entropy falls and repetition shrinks as the power grows to 1. A target above log(sources) gives power 0, one below
    the entropy of the shares themselves gives 1; a limit that even power 1 exceeds gives 1.
    """
    lo, hi = 0.0, 1.0
    if target_entropy is not None:
        if shares.entropy(1.0) >= target_entropy:
            return 1.0
        if shares.entropy(0.0) <= target_entropy:
            return 0.0
        for _ in range(rounds):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if shares.entropy(mid) >= target_entropy else (lo, mid)
        return lo
    if most_repeats is None or shares.repetition(0.0, covering, scale) <= most_repeats:
        return 0.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if shares.repetition(mid, covering, scale) <= most_repeats else (mid, hi)
    return hi


ADDED = ["_epoch", "_tokens", "_weight", "_power", "_block", "_slot"]


def mixed(docs: DataFrame, target_entropy: float | None = None, most_repeats: float | None = 2.0, budget: int | None = None, block_tokens: int = 1 << 18, seed: int = 17, columns: list[str] | None = None) -> DataFrame:
    """docs (all its columns, or those named) with _epoch, _tokens, _weight, _power, _block and _slot added: one row per reading of a document.

    Tokens are the whitespace-separated words of the text, one at least. Without a budget the smallest one is taken in
    which every source is read whole at least once, so no document is lost; with one, a source is read until its part
    is used, and the document at the end is read whole if its first token lies within. A null source is a source of its
    own. Repeated rows are documents of their own; null texts count one token. An empty table gives an empty result.

    A source with a third of all rows is permuted and summed in BUCKETS buckets of the permutation. The weights are a table
    with a row per source, which is broadcast up to SOURCES_AT_ONCE rows and joined otherwise. Columns named like those
    added are replaced; all others come back as they are, whatever their names.
    """
    word = F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    order = F.xxhash64("doc_id", F.col("text"), F.lit(seed))
    without = ADDED if columns is None else [c for c in docs.columns if c not in columns]
    told = docs.select(whole_row(docs, *without), F.col("doc_id").alias("id"), word.alias("tokens"), key.alias("source"), order.alias("order")).withColumn("bucket", F.pmod(F.shiftright("order", 40), F.lit(BUCKETS)).cast("int"))
    per = stage(told.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum")))  # at most BUCKETS rows per source
    totals = stage(per.groupBy("source").agg(F.sum("sum").alias("total")))
    whole, many = totals.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*")).first()
    if not many:
        none = [F.lit(0), F.col("tokens"), F.lit(0.0), F.lit(0.0), F.lit(0).cast("long"), F.lit(0)]
        return told.select("row.*", *[x.alias(name) for name, x in zip(ADDED, none)])
    share = totals.select((F.col("total") / F.lit(float(whole))).alias("share"))
    shares = Shares(np.array([r[0] for r in share.collect()]) if many <= SOURCES_AT_ONCE else share)
    power = bisect_power(shares, target_entropy, most_repeats if target_entropy is None else None, budget is None, (budget or whole) / whole)
    norm, _, least, _ = shares.at(power)
    weight = F.pow(F.col("total") / F.lit(float(whole)), F.lit(power)) / F.lit(float(norm))
    # without a budget: the source that is read least, the one of the largest share, is read once
    use = float(budget) if budget is not None else whole * norm / least
    planned = totals.select("source", "total", weight.alias("weight"), (weight * F.lit(use)).alias("quota"))
    planned = planned.withColumn("epochs", F.greatest(F.lit(1), F.ceil(F.col("quota") / F.col("total") - 1e-9)).cast("int"))
    planned = F.broadcast(planned) if many <= SOURCES_AT_ONCE else planned
    # where each document begins in its source's permutation: totals of buckets first, then within the bucket
    prior = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("source", "bucket", F.coalesce(F.sum("sum").over(prior), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = told.withColumn("begin", F.sum("tokens").over(within) - F.col("tokens")).join(base, ["source", "bucket"]).join(planned, "source").withColumn("begin", F.col("begin") + F.col("base"))
    read = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).withColumn("from", F.col("begin") + F.col("epoch") * F.col("total")).where(F.col("from") < F.col("quota") - 1e-6)
    blocks = max(1, math.ceil(use / block_tokens))
    read = read.withColumn("block", F.least(F.lit(blocks - 1), F.floor(F.col("from") / F.col("quota") * blocks)).cast("long"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("order", "epoch", "block"), "id")) - 1
    found = [F.col("epoch"), F.col("tokens"), F.col("weight"), F.lit(power), F.col("block"), slot]
    return read.select("row", *[x.alias(name) for name, x in zip(ADDED, found)]).select("row.*", *ADDED)


def mixture(docs: DataFrame, most_repeats: float = 2.0) -> DataFrame:
    """(doc_id, source, epoch, tokens, weight, power, block, slot) of every reading."""
    out = mixed(docs, most_repeats=most_repeats, columns=["doc_id", "source"])
    return out.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_tokens").alias("tokens"), F.col("_weight").alias("weight"), F.col("_power").alias("power"), F.col("_block").alias("block"), F.col("_slot").alias("slot"))
