"""Calibration, churn, learning and health figures of a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The bars at which a ledger counts as unhealthy; the first two are breached from below.
BARS = {
    "trigger_recall": 0.90, "trigger_precision": 0.60, "mean_flags": 37.0, "max_flags": 270.0, "max_material_churn": 8.0, "max_fanout": 100.0,
    "brier": 0.25, "override_rate": 0.20, "n_open_contradictions": 10.0,
}
BELOW = ("trigger_recall", "trigger_precision")
#: Outcomes needed to learn, versions needed to decay, largest decay, revisions that churn looks at, smallest move.
MIN_OUTCOMES, MIN_VERSIONS, MAX_DECAY, LAST, TINY = 3, 5, 0.5, 10, 1e-9


def brier(cases: DataFrame, score: str = "score", outcome: str = "outcome") -> DataFrame:
    """One row: n, brier (mean squared error; null without cases)."""
    return cases.agg(F.count(score).alias("n"), F.avg(F.pow(F.col(score) - F.col(outcome), 2)).alias("brier"))


def learned_entrenchment(cases: DataFrame, live: DataFrame, *, least: int = MIN_OUTCOMES) -> DataFrame:
    """claim_id, old, new, n: 1 - Brier for live claims with enough outcomes, where that differs from what they have."""
    per = cases.groupBy("claim_id").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("score") - F.col("outcome"), 2)).alias("brier")).where(F.col("n") >= least)
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("brier")))
    out = per.join(live.select("claim_id", F.col("entrenchment").alias("old")), "claim_id").withColumn("new", new)
    return out.where(F.abs(F.col("new") - F.col("old")) >= TINY).select("claim_id", "old", "new", "n")


def stability_decay(versions: DataFrame, live: DataFrame, learned: DataFrame) -> DataFrame:
    """claim_id, versions, flips, old, new: churning claims without enough outcomes lose entrenchment."""
    w = Window.partitionBy("claim_id").orderBy("from_us")
    side = F.col("score") > 0.5
    v = versions.select("claim_id", (F.lag(side).over(w) != side).cast("int").alias("flip"))
    v = v.groupBy("claim_id").agg(F.count("*").alias("versions"), F.coalesce(F.sum("flip"), F.lit(0)).alias("flips")).where(F.col("versions") >= MIN_VERSIONS)
    v = v.join(learned.select("claim_id"), "claim_id", "left_anti").join(live.select("claim_id", F.col("entrenchment").alias("old")), "claim_id")
    new = F.col("old") * (F.lit(1.0) - F.least(F.lit(MAX_DECAY), F.col("flips") / F.col("versions")))
    return v.withColumn("new", new).where(F.col("old") - F.col("new") >= TINY)


def last_revisions(revisions: DataFrame, keys: list[str], order: str = "seq", last: int = LAST) -> DataFrame:
    """keys, hist: the last revisions of each key in order, as array of (seq, old, new).

    Top-k per key: the rank filter is applied before the shuffle too, so no key brings more than k rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    top = revisions.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= last)
    item = F.struct(F.col(order).alias("seq"), F.col("old_score").alias("old"), F.col("new_score").alias("new"))
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("hist"))


def _turns(dirs: Column) -> Column:
    """How often neighbours in an array of signs differ."""
    pairs = F.zip_with(F.slice(dirs, 2, 1000), F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0))), lambda a, b: (a != b).cast("int"))
    return F.coalesce(F.aggregate(pairs, F.lit(0), lambda a, x: a + x), F.lit(0))


def churn(hist: DataFrame, band: Column) -> DataFrame:
    """hist with raw, gross_travel, conflict_balance, material_moves, material_churn over the last revisions.

    ``band`` is the claim's materiality: a move counts once the score is that far from its anchor.
    """
    deltas = F.filter(F.transform("hist", lambda x: x["new"] - x["old"]), lambda d: F.abs(d) > TINY)
    sign = F.transform("_d", lambda d: F.signum(d).cast("int"))
    total = lambda f: F.aggregate(F.filter("_d", f), F.lit(0.0), lambda a, x: a + F.abs(x))
    df = hist.withColumn("_d", deltas).withColumn("_up", total(lambda d: d > 0)).withColumn("_down", total(lambda d: d < 0))
    both = F.col("_up") + F.col("_down")
    start = F.struct(F.element_at("hist", 1)["old"].alias("a"), F.array().cast("array<int>").alias("dirs"))

    def step(acc: Column, x: Column) -> Column:
        far = F.abs(x["new"] - acc["a"]) >= F.col("_band")
        way = F.when(x["new"] > acc["a"], 1).otherwise(-1)
        return F.when(far, F.struct(x["new"].alias("a"), F.concat(acc["dirs"], F.array(way)).alias("dirs"))).otherwise(acc)

    df = df.withColumn("_band", band).withColumn("_dirs", F.aggregate("hist", start, step)["dirs"])
    return df.select(
        *[c for c in hist.columns if c != "hist"], _turns(sign).alias("raw"), both.alias("gross_travel"),
        F.when(both > 0, F.lit(2.0) * F.least("_up", "_down") / both).otherwise(F.lit(0.0)).alias("conflict_balance"),
        F.size("_dirs").alias("material_moves"), _turns(F.col("_dirs")).alias("material_churn"),
    )


def override_rate(log: DataFrame) -> DataFrame:
    """One row: score revisions, those made by hand (actor ``human``, no triggering event), and their ratio."""
    r = log.where("type = 'score_revision'")
    hand = F.sum(F.when((F.col("actor") == "human") & F.col("p.triggering_event_id").isNull(), 1).otherwise(0))
    return r.agg(F.count("*").alias("n"), F.coalesce(hand, F.lit(0)).alias("manual"), (hand / F.count("*")).alias("rate"))


def trigger_log(log: DataFrame) -> DataFrame:
    """One row: passes of revision in the log, and the mean and largest number of flags they raised (0 without any)."""
    n = F.coalesce("p.n_flags", F.lit(0))
    return log.where("type = 'revisit'").agg(F.count("*").alias("n_revisits"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_flags"), F.coalesce(F.max(n), F.lit(0)).alias("max_flags"))


def kill_bars(values: DataFrame) -> DataFrame:
    """criterion, value, bar, breached from a one-row table of values; criteria without a value are skipped."""
    have = [b for b in BARS if b in values.columns]
    rows = F.array(*[F.struct(F.lit(b).alias("criterion"), F.col(b).cast("double").alias("value"), F.lit(BARS[b]).alias("bar"), F.lit(b in BELOW).alias("below")) for b in have])
    v = values.select(F.explode(rows).alias("r")).select("r.*").where("value IS NOT NULL")
    return v.select("criterion", "value", "bar", F.when(F.col("below"), F.col("value") < F.col("bar")).otherwise(F.col("value") > F.col("bar")).alias("breached"))


def coverage(claims: DataFrame, fields: list[str]) -> DataFrame:
    """field, n: rows in which each field is given."""
    counts = claims.agg(*(F.count(f).alias(f) for f in fields))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("r")).select("r.*")


#: White space as Unicode has it, with the separators that only some libraries count.
_SPACE = r"[\s\x1c-\x1f\x85   -     　]+"


def fingerprint(statement: Column) -> Column:
    """SHA-256 of a proposition with runs of white space as one blank."""
    return F.sha2(F.trim(F.regexp_replace(statement, _SPACE, " ")), 256)


def fingerprint_census(claims: DataFrame) -> DataFrame:
    """fingerprint, n for propositions that more than one claim states."""
    return claims.groupBy(fingerprint(F.col("statement")).alias("fingerprint")).agg(F.count("*").alias("n"))
