"""Provenance relations of a log: entities, activities, agents, generation, association, derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entities(log: DataFrame) -> DataFrame:
    return log.select("store", F.concat(F.lit("record-"), F.col("seq").cast("string")).alias("entity"), "type", "hash")


def agents(log: DataFrame) -> DataFrame:
    """store, actor, agent: a slug per actor; actors whose slugs collide get a number in the order first seen."""
    first = log.groupBy("store", "actor").agg(F.min("seq").alias("first"))
    slug = first.withColumn("slug", F.regexp_replace("actor", r"[^A-Za-z0-9._-]", "-"))
    n = F.row_number().over(Window.partitionBy("store", "slug").orderBy("first"))
    return slug.withColumn("n", n).select("store", "actor", F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("n").cast("string"))).alias("agent"))


def derivations(log: DataFrame) -> DataFrame:
    """store, entity, used: records that name another record of the slice as what they derive from (``derived_from``, integers)."""
    ref = F.transform(F.from_json(F.get_json_object("payload", "$.derived_from"), "array<long>"), lambda x: x)
    one = F.get_json_object("payload", "$.derived_from").try_cast("long")
    refs = F.coalesce(ref, F.when(one.isNotNull(), F.array(one)))
    d = log.select("store", "seq", F.explode(refs).alias("used"))
    return d.join(log.select("store", F.col("seq").alias("used")), ["store", "used"], "left_semi").select("store", "seq", "used")


def claim_trail(log: DataFrame) -> DataFrame:
    """store, seq, used: a claim's record and the record of the same claim before it, from the log's own order."""
    key = F.coalesce("p.claim_id", "p.old_claim_id")
    e = log.select("store", "seq", key.alias("claim_id")).where("claim_id IS NOT NULL")
    from beliefloom.operators.ordered import running

    e = running(e, ["store", "claim_id"], "seq", {}, {"next": F.col("seq")})
    return e.where("next IS NOT NULL").select("store", F.col("next").alias("seq"), F.col("seq").alias("used"))


def document(log: DataFrame) -> DataFrame:
    """The relations of a log as rows (store, relation, a, b) ready to be written as PROV-JSON by store."""
    who = agents(log)
    e = log.join(who, ["store", "actor"])
    name = F.concat(F.lit("record-"), F.col("seq").cast("string"))
    act = F.concat(F.lit("event-"), F.col("seq").cast("string"))
    rel = lambda r, a, b: F.struct(F.lit(r).alias("relation"), a.alias("a"), b.alias("b"))
    rows = e.select("store", F.explode(F.array(rel("entity", name, F.col("type")), rel("activity", act, F.col("t")), rel("wasGeneratedBy", name, act), rel("wasAssociatedWith", act, F.col("agent")))).alias("r")).select("store", "r.*")
    ag = who.select("store", F.lit("agent").alias("relation"), F.col("agent").alias("a"), F.col("actor").alias("b"))
    der = derivations(log).select("store", F.lit("wasDerivedFrom").alias("relation"), name.alias("a"), F.concat(F.lit("record-"), F.col("used").cast("string")).alias("b"))
    return rows.unionByName(ag).unionByName(der)
