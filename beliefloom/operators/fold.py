"""Log to state: claim versions, support edges, slowly changing tables, matrix, evidence map."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefloom.operators.ordered import running

#: Entrenchment that a writer's tier gives by default; without a writer, and for an unknown one.
TIERS = {"owner": 0.75, "contributor": 0.5, "provisional": 0.25}
NO_WRITER, UNKNOWN_WRITER = 0.5, 0.25
_STATIC = ("statement", "valid_from", "valid_to", "score_kind", "materiality", "critical", "writer", "source", "falsifier", "does_not_establish")


def claim_versions(log: DataFrame) -> DataFrame:
    """One row per version of a claim: store, claim_id, seq, txn_from, txn_to, score, entrenchment, status and static fields.

    An assert opens a claim, a score revision or a new entrenchment opens its next version and closes the one before,
    a terminal event (status change, supersede) closes the last version and rewrites that version's status.  Changes
    to a claim that is not live do not count.  Order is that of seq, never of t.  An assert without an entrenchment gets
    what its writer's tier gives at that moment.
    """
    kinds = ("assert", "score_revision", "entrenchment_set", "supersede", "claim_status_changed")
    p = lambda f: F.col(f"p.{f}")
    is_ = lambda *k: F.col("type").isin(*k)
    ev = log.where(is_(*kinds)).select(
        "store", F.when(is_("supersede"), p("old_claim_id")).otherwise(p("claim_id")).alias("claim_id"), "seq", "t", "t_us", "type",
        p("new_score").alias("new_score"), p("prior").alias("prior"), p("new").alias("new_ent"), p("entrenchment").alias("ent0"),
        p("status").alias("new_status"), *(p(c).alias(c) for c in _STATIC),
    ).where("claim_id IS NOT NULL")
    keys = ["store", "claim_id"]
    before_end = is_("supersede", "claim_status_changed")
    # A terminal event counts if an assert is the structural event before it.
    ev = running(ev, keys, "seq", {"opened": F.when(is_("assert"), F.struct("seq"))})
    ends = ev.where(before_end & F.col("opened").isNotNull()).groupBy(*keys, "opened").agg(F.min("seq").alias("end_seq"))
    ev = ev.join(ends, [*keys, "opened"], "left").where(F.col("opened").isNotNull() & (F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq"))))
    ev = ev.drop("opened", "end_seq")
    ev = ev.join(writer_tiers(log), ["store", "seq"], "left")
    default = F.coalesce("ent0", default_entrenchment(F.col("writer"), F.col("tier")))
    opened = is_("assert")
    keep = {
        "score": F.when(opened, F.col("prior")).when(is_("score_revision"), F.col("new_score")),
        "entrenchment": F.when(opened, default).when(is_("entrenchment_set"), F.col("new_ent")),
        "fixed": F.when(opened, F.struct(*_STATIC)),
    }
    status = F.when(is_("supersede"), F.lit("superseded")).when(is_("claim_status_changed"), F.col("new_status"))
    v = running(ev, keys, "seq", keep, {"txn_to": F.col("t"), "txn_to_us": F.col("t_us"), "ended": status})
    v = v.where(~before_end)
    return v.select(
        *keys, "seq", F.col("t").alias("txn_from"), "txn_to", F.col("t_us").alias("txn_from_us"), "txn_to_us", "score", "entrenchment",
        F.coalesce("ended", F.lit("active")).alias("status"), "fixed.*",
    )


def writer_tiers(log: DataFrame) -> DataFrame:
    """``store, seq, tier``: the tier that the writer of an assert without an entrenchment had at that moment, if registered."""
    at = F.when(F.col("type") == "assert", F.col("p.writer")).otherwise(F.col("p.writer_id"))
    open_ = (F.col("type") == "assert") & F.col("p.entrenchment").isNull()
    w = log.where((F.col("type") == "writer_registered") | open_).select("store", "seq", "type", at.alias("writer"), F.col("p.tier").alias("given")).where("writer IS NOT NULL")
    w = running(w, ["store", "writer"], "seq", {"tier": F.when(F.col("type") == "writer_registered", F.col("given"))})
    return w.where("type = 'assert' AND tier IS NOT NULL").select("store", "seq", "tier")


def support_edges(log: DataFrame) -> DataFrame:
    """Support edges with the time of their retraction: a retraction closes all live rows of its pair."""
    e = log.where(F.col("type").isin("support", "retract_support")).select(
        "store", "seq", "t", "type", F.col("p.claim_id").alias("claim_id"), F.col("p.supports_id").alias("supports_id"), F.col("p.kind").alias("kind"),
        F.col("p.p_given").alias("p_given"), F.col("p.p_given_not").alias("p_given_not"), F.coalesce("p.strength", F.lit(1.0)).alias("strength"),
    ).where("claim_id IS NOT NULL AND supports_id IS NOT NULL")
    keys = ["store", "claim_id", "supports_id"]
    # Backwards in seq: the first retraction after a row is the last one seen when reading from the end.
    e = running(e.withColumn("_down", -F.col("seq")), keys, "_down", {"txn_to": F.when(F.col("type") == "retract_support", F.col("t"))})
    return e.where("type = 'support'").select(*keys, "seq", "kind", "p_given", "p_given_not", "strength", F.col("t").alias("txn_from"), "txn_to")


def scd2(df: DataFrame, keys: Sequence[str], order: str, t: str, values: Sequence[str]) -> DataFrame:
    """Any slowly changing table: each row is live until the next row of its key."""
    out = running(df.select(*keys, order, t, *values), keys, order, {}, {"txn_to": F.col(t)})
    return out.select(*keys, order, *values, F.col(t).alias("txn_from"), "txn_to")


def outcomes(log: DataFrame) -> DataFrame:
    o = log.where("type = 'outcome'")
    return o.select("store", "seq", F.col("p.claim_id").alias("claim_id"), F.col("p.outcome").cast("int").alias("outcome"), "t", "t_us")


def decisions(log: DataFrame) -> DataFrame:
    """Explicit decisions and the governance events that count as ones: store, seq, t, kind, actor, label, basis (asserted claims)."""
    asserted = log.where("type = 'assert'").select("store", F.col("p.claim_id").alias("claim_id")).distinct()
    kinds = ("decision", "supersede", "claim_status_changed", "contradiction_resolved")
    refs = F.when(F.col("type") == "decision", F.col("p.basis")).otherwise(F.array("p.claim_id", "p.old_claim_id", "p.new_claim_id"))
    d = log.where(F.col("type").isin(*kinds)).select("store", "seq", "t", F.col("type").alias("kind"), "actor", F.coalesce("p.label", "p.reason").alias("label"), F.array_distinct(F.array_compact(refs)).alias("refs"))
    known = d.select("store", "seq", F.posexplode("refs").alias("at", "claim_id")).join(asserted, ["store", "claim_id"], "left_semi")
    basis = known.groupBy("store", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "claim_id"))), lambda x: x["claim_id"]).alias("basis"))
    return d.drop("refs").join(basis, ["store", "seq"], "left").withColumn("basis", F.coalesce("basis", F.array().cast("array<string>")))


def matrix(log: DataFrame) -> DataFrame:
    """Per asserted claim: latest confidence, status and successor, straight from the events, and the seq of its assertion."""
    key = F.when(F.col("type") == "supersede", F.col("p.old_claim_id")).otherwise(F.col("p.claim_id"))
    e = log.where(F.col("type").isin("assert", "score_revision", "supersede", "claim_status_changed")).withColumn("claim_id", key)
    score = F.when(F.col("type") == "assert", F.col("p.prior")).when(F.col("type") == "score_revision", F.col("p.new_score"))
    state = F.when(F.col("type") == "assert", F.lit("active")).when(F.col("type") == "supersede", F.lit("superseded")).when(F.col("type") == "claim_status_changed", F.col("p.status"))
    at = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    m = e.groupBy("store", "claim_id").agg(
        F.min(F.when(F.col("type") == "assert", F.col("seq"))).alias("assert_seq"), at(score).alias("confidence"), at(state).alias("status"),
        at(F.col("p.new_claim_id")).alias("superseded_by"),
    )
    return m.where("assert_seq IS NOT NULL AND claim_id IS NOT NULL")


def evidence(log: DataFrame) -> DataFrame:
    """Events that mention a claim, by any reference: store, claim_id, seq, deduplicated."""
    refs = F.array_compact(F.concat(F.array("p.claim_id", "p.old_claim_id", "p.new_claim_id", "p.supports_id"), F.coalesce("p.basis", F.array().cast("array<string>"))))
    return log.select("store", "seq", F.explode(F.array_distinct(refs)).alias("claim_id"))


def default_entrenchment(writer: Column, tier: Column) -> Column:
    """What an assert without an entrenchment gets: by its writer's tier at that moment."""
    c = F.when(writer.isNull(), F.lit(NO_WRITER))
    for name, value in TIERS.items():
        c = c.when(tier == name, F.lit(value))
    return c.otherwise(F.lit(UNKNOWN_WRITER))


def combos(log: DataFrame) -> DataFrame:
    """Versions of each claim's joint likelihood: combo, leak, strengths, live until the next."""
    c = log.where("type = 'combo_set'").select("store", F.col("p.claim_id").alias("claim_id"), "seq", "t", F.col("p.combo").alias("combo"), F.col("p.leak").alias("leak"), F.col("p.strengths").alias("strengths"))
    return scd2(c.where("claim_id IS NOT NULL"), ["store", "claim_id"], "seq", "t", ["combo", "leak", "strengths"])


def with_strengths(edges: DataFrame, log: DataFrame) -> DataFrame:
    """support_edges with the strength that the last combo of the claim gives a supporter while the edge is live; edges get no new version."""
    c = log.where("type = 'combo_set'").select("store", F.col("p.claim_id").alias("claim_id"), F.col("seq").alias("c_seq"), F.col("t").alias("c_t"), F.explode("p.strengths").alias("supports_id", "s"))
    keys = ["store", "claim_id", "supports_id"]
    hit = edges.join(c, keys).where((F.col("c_seq") > F.col("seq")) & (F.col("txn_to").isNull() | (F.col("c_t") < F.col("txn_to"))))
    last = hit.groupBy(*keys, "seq").agg(F.max_by("s", "c_seq").alias("s"))
    return edges.join(last, [*keys, "seq"], "left").withColumn("strength", F.coalesce("s", "strength")).drop("s")


#: Which payload field is the key, and which are the values, of each slowly changing table.
REGISTERS = {
    "writers": ("writer_registered", "writer_id", ("tier", "pubkey")), "policies": ("policy_registered", "name", ("version", "description")),
    "graphs": ("graph_registered", "graph", ("ceiling",)), "claim_graphs": ("graph_assigned", "claim_id", ("graph",)),
    "claim_topics": ("topic_assigned", "claim_id", ("topic",)), "claim_intervals": ("interval_set", "claim_id", ("belief", "plausibility")),
}


def register(log: DataFrame, name: str) -> DataFrame:
    """A slowly changing table by name: store, key, values, txn_from, txn_to.  A writer registered anew without a key keeps the old one."""
    kind, key, values = REGISTERS[name]
    r = log.where(F.col("type") == kind).select("store", F.col(f"p.{key}").alias(key), "seq", "t", *(F.col(f"p.{v}").alias(v) for v in values)).where(F.col(key).isNotNull())
    if name == "writers":
        r = running(r.withColumnRenamed("pubkey", "given"), ["store", key], "seq", {"pubkey": F.col("given")}).drop("given")
    return scd2(r, ["store", key], "seq", "t", values)


def lookup(log: DataFrame, name: str, events: DataFrame, key: str) -> DataFrame:
    """events (store, seq, ``key``) with the values of a register that were in force at their seq, null if none were.

    This is what an audit asks: a writer's tier and key, a policy's version, a graph's ceiling at the time of an event.
    """
    kind, own, values = REGISTERS[name]
    r = log.where(F.col("type") == kind).select("store", "seq", F.col(f"p.{own}").alias("_key"), F.struct(*(F.col(f"p.{v}").alias(v) for v in values)).alias("_given")).where("_key IS NOT NULL")
    e = events.withColumn("_key", F.col(key)).withColumn("_asks", F.lit(True))
    both = e.unionByName(r.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    # Of two rows with one seq, the registration comes after the event that asks.
    both = both.withColumn("_at", F.col("seq") * 2 + F.when(F.col("_asks"), 0).otherwise(1))
    last = {f"_v_{v}": F.when(~F.col("_asks"), F.col("_given")[v] if v == "pubkey" else F.struct(F.col("_given")[v].alias("v"))) for v in values}
    out = running(both, ["store", "_key"], "_at", last).where("_asks")
    return out.select(*events.columns, *(F.col(f"_v_{v}" if v == "pubkey" else f"_v_{v}.v").alias(v) for v in values))


def accessor(log: DataFrame, name: str, ids: DataFrame, key: str, default: dict | None = None) -> DataFrame:
    """ids (store, ``key``) with the live values of a register; where there are none, those of ``default``."""
    kind, own, values = REGISTERS[name]
    live = register(log, name).where("txn_to IS NULL").select("store", F.col(own).alias(key), *values)
    out = ids.join(live, ["store", key], "left")
    return out.withColumns({v: F.coalesce(v, F.lit(x)) for v, x in (default or {}).items()})


def write_projection(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes folded tables as Parquet under a new version of ``folder`` and then names it as current; returns the version.

    Readers see the old version or the new one, never a mixture; versions before are left to the caller to delete.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}")
    fs = path("").getFileSystem(conf)
    out = fs.create(path(f"CURRENT.{version}"), True)
    out.write(bytearray(version.encode()))
    out.close()
    fs.delete(path("CURRENT"), False)
    if not fs.rename(path(f"CURRENT.{version}"), path("CURRENT")):
        raise OSError(f"{folder}/CURRENT could not be renamed")
    return version


def read_projection(spark: SparkSession, folder: str, name: str) -> DataFrame:
    version = spark.read.text(f"{folder}/CURRENT").first()[0]
    return spark.read.parquet(f"{folder}/{version}/{name}")


def rebuild(log: DataFrame, folder: str) -> dict[str, int]:
    """Folds a log into all its tables, verifies them and makes them current; returns the rows of each table."""
    tables = {"claims": claim_versions(log), "support_edges": support_edges(log), "outcomes": outcomes(log), "decisions": decisions(log), "combos": combos(log)}
    tables |= {name: register(log, name) for name in REGISTERS}
    unknown = log.where("type IS NULL").limit(1).count()
    if unknown:
        raise ValueError("records without a type cannot be folded")
    version = write_projection(tables, folder)
    spark = log.sparkSession
    return {name: spark.read.parquet(f"{folder}/{version}/{name}").count() for name in tables}
