"""Belief arithmetic as Column expressions: conditioning, joint likelihoods, evidence intervals, abstention."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for likelihoods and the credence each stands for.
VERBAL = {"almost certain": 0.95, "very likely": 0.85, "likely": 0.70, "toss-up": 0.50, "unlikely": 0.30, "very unlikely": 0.15, "almost impossible": 0.05}


def jeffrey(p_given: Column, p_given_not: Column, new: Column) -> Column:
    """Probability of a claim after its supporter moved to ``new``; the prior plays no part."""
    return p_given * new + p_given_not * (F.lit(1.0) - new)


def noisy_and(scores: Column, strengths: Column, leak: Column) -> Column:
    """leak + (1 - leak) * prod(s * p + 1 - s), over arrays in the same order."""
    terms = F.zip_with(scores, strengths, lambda p, s: s * p + (F.lit(1.0) - s))
    return leak + (F.lit(1.0) - leak) * F.aggregate(terms, F.lit(1.0), lambda a, x: a * x)


def noisy_or(scores: Column, strengths: Column, leak: Column) -> Column:
    """1 - (1 - leak) * prod(1 - s * p)."""
    terms = F.zip_with(scores, strengths, lambda p, s: F.lit(1.0) - s * p)
    return F.lit(1.0) - (F.lit(1.0) - leak) * F.aggregate(terms, F.lit(1.0), lambda a, x: a * x)


def conflict(b1: Column, p1: Column, b2: Column, p2: Column) -> Column:
    """Dempster conflict K of two binary evidence intervals [belief, plausibility]."""
    return b1 * (F.lit(1.0) - p2) + (F.lit(1.0) - p1) * b2


def combine(b1: Column, p1: Column, b2: Column, p2: Column, refuse: float = 0.99) -> Column:
    """struct(belief, plausibility) of two combined intervals; null if the conflict is at least ``refuse``."""
    k = conflict(b1, p1, b2, p2)
    t = b1 * b2 + b1 * (p2 - b2) + (p1 - b1) * b2
    u = (p1 - b1) * (p2 - b2)
    scale = F.lit(1.0) - k
    return F.when(k < refuse, F.struct((t / scale).alias("belief"), ((t + u) / scale).alias("plausibility")))


def ignorance_gate(belief: Column, plausibility: Column, threshold: float) -> Column:
    """``abstain`` if the interval is wider than the threshold, else ``act``, also without an interval."""
    return F.when(plausibility - belief > threshold, "abstain").otherwise("act")


def credence_band(score: Column, act: float = 0.7, abstain: float = 0.3) -> Column:
    return F.when(score >= act, "act").when(score <= abstain, "abstain").when(score.isNotNull(), "escalate")


def verbal(word: Column) -> Column:
    """The credence a likelihood word stands for, or null."""
    word = F.lower(F.trim(word))
    return reduce(lambda c, kv: c.when(word == kv[0], F.lit(kv[1])), VERBAL.items(), F.when(F.lit(False), F.lit(0.0)))


def elicit_pair(given: Column, given_not: Column) -> Column:
    """struct(p_given, p_given_not, counter) of two likelihood words; counter: the edge speaks against the claim, so it wants a second look."""
    p, q = verbal(given), verbal(given_not)
    return F.struct(p.alias("p_given"), q.alias("p_given_not"), (p < q).alias("counter"))


def interval_to_mass(belief: Column, plausibility: Column) -> Column:
    """Mass on true, on false and on either, of an evidence interval."""
    return F.struct(belief.alias("true"), (F.lit(1.0) - plausibility).alias("false"), (plausibility - belief).alias("either"))


def bayes_update(prior: Column, says_true: Column, accuracy: Column, temper: float = 1.0) -> Column:
    """Posterior after a report of a source of known accuracy; ``temper`` below 1 weakens what the report says."""
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), prior))
    for_true = accuracy / (F.lit(1.0) - accuracy)
    odds = p / (F.lit(1.0) - p) * F.pow(F.when(says_true, for_true).otherwise(F.lit(1.0) / for_true), F.lit(temper))
    return odds / (F.lit(1.0) + odds)


def bayes_path(prior: Column, reports: Column, temper: float = 1.0) -> Column:
    """Posterior after an ordered array of reports (says_true, accuracy)."""
    return F.aggregate(reports, prior, lambda p, r: bayes_update(p, r["says_true"], r["accuracy"], temper))


def trust(prior: Column, correct: Column, total: Column, weight: float = 10.0) -> Column:
    """Accuracy of a source, smoothed towards the prior of its tier; the prior where nothing was verified."""
    return F.when(total > 0, (F.lit(weight) * prior + correct) / (F.lit(weight) + total)).otherwise(prior)


def dempster(left: DataFrame, right: DataFrame, keys: Sequence[str], most: float = 1 - 1e-12) -> DataFrame:
    """``keys, subset, mass, conflict``: Dempster's rule over frames of up to 63 elements, a mass function for each key.

    left and right have keys, subset (bits of the elements) and mass.  Products of masses go to the intersection of
    their subsets and are scaled by what does not conflict.  Keys whose conflict is at least ``most`` have one row with
    subset and mass null; keys that only one side has are left out.  Masses of a key that do not sum to 1 are an error.
    """
    sound = []
    for m in (left, right):
        total = m.groupBy(*keys).agg(F.sum("mass").alias("total"))
        bad = F.raise_error(F.concat(F.lit("masses sum to "), F.col("total").cast("string")))
        sound.append(m.groupBy(*keys, "subset").agg(F.sum("mass").alias("mass")).join(total.withColumn("ok", F.when(F.abs(F.col("total") - 1) > 1e-9, bad).otherwise(F.lit(True))).where("ok").drop("total", "ok"), list(keys)))
    a, b = sound[0], sound[1].withColumnsRenamed({"subset": "subset2", "mass": "mass2"})
    both = a.join(b, list(keys)).groupBy(*keys, F.col("subset").bitwiseAND(F.col("subset2")).alias("subset")).agg(F.sum(F.col("mass") * F.col("mass2")).alias("mass"))
    clash = both.groupBy(*keys).agg(F.sum(F.when(F.col("subset") == 0, F.col("mass")).otherwise(0.0)).alias("conflict"))
    fine = both.where("subset <> 0").join(clash.where(F.col("conflict") < most), list(keys)).withColumn("mass", F.col("mass") / (1 - F.col("conflict")))
    none = clash.where(F.col("conflict") >= most).select(*keys, F.lit(None).cast(left.schema["subset"].dataType).alias("subset"), F.lit(None).cast("double").alias("mass"), "conflict")
    return fine.select(*keys, "subset", "mass", "conflict").unionByName(none)
