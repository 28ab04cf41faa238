"""A story in a few events: beliefs, evidence against one of them, and what that moves."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefloom.functions import canonical as C
from beliefloom.operators import fold, revision
from beliefloom.operators import write as W
from beliefloom.sources.logs import clean_log

T = "2025-01-01T00:00:00Z"


def story_log(spark: SparkSession) -> DataFrame:
    """The log of a mill: the weir holds, so the wheel turns, so the mill can grind; the bakery needs flour and wood."""
    said = [("weir", "The weir holds the water.", 0.9), ("wheel", "The wheel turns.", 0.8), ("mill", "The mill can grind.", 0.7), ("wood", "There is wood.", 0.9), ("bread", "There will be bread.", 0.6)]
    events = [W.assert_claim(c, s, p, t=T, materiality=0.1, critical=c == "bread") for c, s, p in said]
    events += [W.add_support(a, b, "deductive", p, q, t=T) for a, b, p, q in (("wheel", "weir", 0.95, 0.05), ("mill", "wheel", 0.9, 0.0), ("bread", "mill", 0.8, 0.1), ("bread", "wood", 0.7, 0.2))]
    events += [W.set_combo("bread", "noisy-and", 0.0, {"mill": 1.0, "wood": 0.5}, t=T), W.record_decision("D1", "order flour", ["mill"], t=T)]
    rows, prev = [], C.GENESIS
    for seq, e in enumerate(events, 1):
        h = C.record_hash(seq, e["t"], e["actor"], e["type"], e["payload"], prev)
        rows.append(("mill", seq, e["t"], e["actor"], e["type"], json.dumps(e["payload"]), prev, h, None))
        prev = h
    return clean_log(spark.createDataFrame(rows, "store string, seq long, t string, actor string, type string, payload string, prev_hash string, hash string, sig string"))


def story(spark: SparkSession) -> DataFrame:
    """``claim_id, old, new, flagged, decision_id``: what moves when the weir breaks, and which decisions rested on it."""
    log = story_log(spark)
    live = fold.claim_versions(log).where("txn_to IS NULL").select("claim_id", "score", "materiality", "critical", "entrenchment")
    edges = fold.with_strengths(fold.support_edges(log), log).where("txn_to IS NULL").withColumn("from_us", F.col("seq"))
    combos = fold.combos(log).where("txn_to IS NULL").select("claim_id", "combo", "leak")
    roots = spark.createDataFrame([("weir", 0.0)], "root string, score double")
    moves, _ = revision.report(live, edges, roots, combos)
    decisions = fold.decisions(log).where("kind = 'decision'").select(F.col("label").alias("decision_id"), "basis")
    hit = decisions.select("decision_id", F.explode("basis").alias("claim_id"))
    return moves.join(hit, "claim_id", "left").orderBy("position").select("claim_id", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), "flagged", "decision_id")
