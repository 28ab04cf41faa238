"""Contradictions: detection by opposed scores or clashing intervals, open and held queues, who gives way."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefloom.functions.belief import conflict, jeffrey
from beliefloom.operators import graph
from beliefloom.session import cut

#: How far apart opposed scores and how large a conflict must be; entrenchment that counts as a tie.
OPPOSED, CONFLICT, TIE = 0.7, 0.7, 1e-9


def _side(df: DataFrame, key: str, tag: str) -> DataFrame:
    return df.select(key, *(F.col(c).alias(f"{c}_{tag}") for c in df.columns if c != key))


def opposed_siblings(claims: DataFrame, ancestors: DataFrame, least: float = OPPOSED) -> DataFrame:
    """``claim_a, claim_b``: live claims on opposite sides of 0.5, at least ``least`` apart, that share an ancestor.

    claims: claim_id, score (live); ancestors: claim_id, ancestor.  Pairs are found inside an ancestor only between
    claims that are high enough and claims that are low enough, by an equi-join on (ancestor, slice of the low score):
    a high score s joins the slices up to s - least, so no pair beyond the threshold is formed.
    """
    s = claims.where("score IS NOT NULL").join(ancestors, "claim_id")
    step = 0.05
    high = s.where(F.col("score") > 0.5).select("ancestor", F.col("claim_id").alias("x"), F.col("score").alias("sx"))
    low = s.where(F.col("score") < 0.5).select("ancestor", F.col("claim_id").alias("y"), F.col("score").alias("sy"), F.floor(F.col("score") / step).cast("int").alias("cell"))
    cells = F.sequence(F.lit(0), F.floor((F.col("sx") - least) / step + 1e-9).cast("int"))
    high = high.where(F.col("sx") - least >= -1e-12).withColumn("cell", F.explode(cells))
    hit = high.join(low, ["ancestor", "cell"]).where(F.col("sx") - F.col("sy") >= least)
    return hit.select(F.least("x", "y").alias("claim_a"), F.greatest("x", "y").alias("claim_b")).distinct()


def opposed_lineage(claims: DataFrame, edges: DataFrame, least: float = OPPOSED) -> DataFrame:
    """opposed_siblings() with the ancestors that support edges (claim_id, supports_id) give; claims: one row per claim_id.

    Graphs and claims of a proven bounded size are walked with bit sets, a block of low claims in each task: the sets go
    up to all ancestors, then down again as the low claims that share one, and meet the high claims' scores there.
    """
    c = cut(claims.select(F.col("claim_id").cast("string").alias("claim_id"), F.col("score").cast("double").alias("score")).where("claim_id IS NOT NULL AND score IS NOT NULL AND score <> 0.5"))
    g = graph.lineage(edges, "claim_id", "supports_id") if c.limit(graph.KERNEL_EDGES + 1).count() <= graph.KERNEL_EDGES else None
    if g is None:
        return opposed_siblings(claims, graph.closure(edges, "claim_id", "supports_id").select("claim_id", F.col("supports_id").alias("ancestor")), least)
    got = c.toArrow()
    at, score = np.asarray(pc.fill_null(pc.index_in(got.column("claim_id").combine_chunks(), g["names"]), -1)), np.asarray(got.column("score").combine_chunks())
    rests = np.flatnonzero(at >= 0)
    rests = rests[g["rests"][g["group"][at[rests]]]]
    high, low = rests[score[rests] > 0.5], rests[score[rests] < 0.5]
    width = 64 * min(8, g["words"])
    shared = edges.sparkSession.sparkContext.broadcast(g | {"high": at[high], "high_score": score[high], "low": at[low], "low_score": score[low]})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        group, some, names = g["group"], 1 << 12, g["names"]
        for b in batches:
            for k in b.column(0).to_pylist():
                y, sy = g["low"][k * width : (k + 1) * width], g["low_score"][k * width : (k + 1) * width]
                own = graph._own(group[y], len(g["cyclic"]), width // 64)
                sets = own.copy()
                graph._spread(sets, g["down"])
                sets[~g["cyclic"]] &= ~own[~g["cyclic"]]
                graph._spread(sets, g["up"])
                for lo in range(0, len(g["high"]), some):
                    x, sx = g["high"][lo : lo + some], g["high_score"][lo : lo + some]
                    hit = np.unpackbits(sets[group[x]].view(np.uint8), axis=1, bitorder="little")[:, : len(y)].astype(bool)
                    i, j = np.nonzero(hit & (sx[:, None] - sy[None, :] >= least))
                    for s in range(0, len(i), 1 << 17):
                        p, q = x[i[s : s + (1 << 17)]], y[j[s : s + (1 << 17)]]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(np.minimum(p, q))), names.take(pa.array(np.maximum(p, q)))], names=["claim_a", "claim_b"])

    return graph._blocks(edges, len(low), width).mapInArrow(pairs, "claim_a string, claim_b string")


def interval_conflicts(intervals: DataFrame, least: float = CONFLICT, cells: int = 20) -> DataFrame:
    """``claim_a, claim_b, k``: claims of one topic whose evidence intervals conflict by at least ``least`` (>= 0.5).

    intervals: claim_id, topic, belief, plausibility.  With doubt d = 1 - plausibility the conflict is b1 d2 + d1 b2.
    One of the terms must reach ``least`` / 2, so one claim has that much belief and the other that much doubt; and as
    b2 <= 1 - d2, d2 must be at least (least - d1) / (b1 - d1) where b1 > d1.  Claims meet by equi-join on (topic, cell
    of doubt) only above that bound; nothing is compared across topics.
    """
    iv = intervals.where("belief IS NOT NULL AND plausibility IS NOT NULL AND topic IS NOT NULL")
    iv = iv.withColumn("doubt", F.lit(1.0) - F.col("plausibility"))
    x = iv.where(F.col("belief") >= least / 2).select("topic", F.col("claim_id").alias("x"), F.col("belief").alias("b1"), F.col("plausibility").alias("p1"), F.col("doubt").alias("d1"))
    y = iv.where(F.col("doubt") >= least / 2).select("topic", F.col("claim_id").alias("y"), F.col("belief").alias("b2"), F.col("plausibility").alias("p2"), F.least(F.floor(F.col("doubt") * cells), F.lit(cells - 1)).cast("int").alias("cell"))
    bound = F.when(F.col("b1") > F.col("d1"), (F.lit(least) - F.col("d1")) / (F.col("b1") - F.col("d1"))).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0), F.least(F.floor(bound * cells - 1e-9), F.lit(cells))).cast("int")
    x = x.withColumn("cell", F.explode(F.when(low <= cells - 1, F.sequence(low, F.lit(cells - 1))).otherwise(F.array().cast("array<int>"))))
    k = conflict(F.col("b1"), F.col("p1"), F.col("b2"), F.col("p2"))
    hit = x.join(y, ["topic", "cell"]).where(F.col("x") != F.col("y")).withColumn("k", k).where(F.col("k") >= least)
    return hit.groupBy(F.least("x", "y").alias("claim_a"), F.greatest("x", "y").alias("claim_b")).agg(F.max("k").alias("k"))


def open_contradictions(log: DataFrame) -> DataFrame:
    """Declared contradictions that are not resolved; log has event_id."""
    done = log.where("type = 'contradiction_resolved'").select(F.col("p.contradiction_id").alias("event_id"))
    return log.where("type = 'contradiction'").join(done, "event_id", "left_anti").select("event_id", "t", F.col("p.claim_a").alias("claim_a"), F.col("p.claim_b").alias("claim_b"))


def held_contradictions(log: DataFrame) -> DataFrame:
    """Held ones that were neither dismissed nor declared since, by id and by ordered pair."""
    pair = [F.col("p.claim_a").alias("claim_a"), F.col("p.claim_b").alias("claim_b")]
    held = log.where("type = 'contradiction_held'").select("event_id", "t", *pair)
    out = log.where("type = 'contradiction_dismissed'").select(F.col("p.held_id").alias("event_id"))
    return held.join(out, "event_id", "left_anti").join(log.where("type = 'contradiction'").select(*pair), ["claim_a", "claim_b"], "left_anti")


def resolution(pairs: DataFrame, claims: DataFrame, p_loser_given_winner: float = 0.1) -> DataFrame:
    """Who gives way in each pair: the less entrenched live claim; its score follows the winner's; a tie is unresolved.

    claims: claim_id, score, entrenchment (effective).  Result: claim_a, claim_b, loser, winner, old, new, outcome.
    """
    a, b = _side(claims.select("claim_id", "score", "entrenchment"), "claim_id", "a"), _side(claims.select("claim_id", "score", "entrenchment"), "claim_id", "b")
    df = pairs.join(a.withColumnRenamed("claim_id", "claim_a"), "claim_a", "left").join(b.withColumnRenamed("claim_id", "claim_b"), "claim_b", "left")
    dead = F.col("score_a").isNull() | F.col("score_b").isNull()
    tie = F.abs(F.col("entrenchment_a") - F.col("entrenchment_b")) < TIE
    a_loses = F.col("entrenchment_a") < F.col("entrenchment_b")
    pick = lambda x, y: F.when(~dead & ~tie, F.when(a_loses, F.col(x)).otherwise(F.col(y)))
    old, won = pick("score_a", "score_b"), pick("score_b", "score_a")
    return df.select(
        "claim_a", "claim_b", pick("claim_a", "claim_b").alias("loser"), pick("claim_b", "claim_a").alias("winner"), old.alias("old"),
        jeffrey(F.lit(p_loser_given_winner), old, won).alias("new"), F.when(dead, "not-live").when(tie, "tie").otherwise("resolved").alias("outcome"),
    )
