"""Reading bitemporal claim tables: repaired histories, live slices, snapshots, change windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beliefloom.functions.text import claim_key, instant_us, plain


def history(claims: DataFrame) -> DataFrame:
    """One row per (claim_id, from_us) of a claims table, with to_us, seq (1, 2, ...) and the claim's columns.

    Rows written twice are one version (the smallest row counts); a version whose end was never written although a
    later one exists ends where that begins.
    """
    c = claims.withColumn("from_us", instant_us(F.col("txn_from"))).withColumn("end_us", instant_us(F.col("txn_to"))).where("claim_id IS NOT NULL AND from_us IS NOT NULL")
    rest = [x for x in claims.columns if x not in ("claim_id", "txn_from", "txn_to")]
    one = c.groupBy("claim_id", "from_us").agg(F.min("end_us").alias("end_us"), F.min(F.struct(*rest)).alias("r")).select("claim_id", "from_us", "end_us", "r.*")
    w = Window.partitionBy("claim_id").orderBy("from_us")
    one = one.withColumn("next_us", F.lead("from_us").over(w)).withColumn("seq", F.row_number().over(w))
    return one.withColumn("to_us", F.least("end_us", "next_us")).drop("end_us", "next_us")


def live(versions: DataFrame, to: str = "to_us") -> DataFrame:
    return versions.where(F.col(to).isNull())


def believed_at(versions: DataFrame, t_us: int, start: str = "from_us", to: str = "to_us") -> DataFrame:
    """The versions in force at an instant: half-open intervals."""
    return versions.where((F.col(start) <= t_us) & (F.col(to).isNull() | (F.col(to) > t_us)))


def changed(log: DataFrame, t1_us: int, t2_us: int, t: str = "t_us") -> DataFrame:
    """Events with t1 <= t < t2."""
    return log.where((F.col(t) >= t1_us) & (F.col(t) < t2_us))


def live_edges(edges: DataFrame) -> DataFrame:
    """Live rows of a support_edges table with canonical ids and kinds, each pair and kind once (the earliest row counts)."""
    e = edges.where(F.col("txn_to").isNull() | (F.trim("txn_to") == "")).select(
        claim_key(F.col("claim_id")).alias("claim_id"), claim_key(F.col("supports_id")).alias("supports_id"), plain(F.col("kind")).alias("kind"),
        "p_given", "p_given_not", "strength", instant_us(F.col("txn_from")).alias("from_us"),
    ).where("claim_id IS NOT NULL AND supports_id IS NOT NULL")
    one = F.min(F.struct("from_us", "p_given", "p_given_not", "strength")).alias("r")
    return e.groupBy("claim_id", "supports_id", "kind").agg(one).select("claim_id", "supports_id", "kind", "r.*")


def why(edges: DataFrame, versions: DataFrame) -> DataFrame:
    """Live edges with the supporter's live statement and score; null for a dead or unknown supporter."""
    s = live(versions).select(F.col("claim_id").alias("supports_id"), F.col("statement").alias("supporter_statement"), F.col("score").alias("supporter_score"))
    return edges.join(s, "supports_id", "left")
