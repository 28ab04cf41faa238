"""Consolidation with a language model as client: prompt, reply parsing, what the verdicts become."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefloom.operators import audit, graph

RELATIONS = ("same", "contradicts", "supports")


def prompt(claims: DataFrame, block: int = 50) -> DataFrame:
    """``block, prompt``: live claims in blocks of bounded size, one line each, ordered by id.

    claims: claim_id, score, statement.
    """
    line = F.format_string("[%s] (credence %.2f) %s", F.col("claim_id"), F.col("score"), F.col("statement"))
    at = F.pmod(F.xxhash64("claim_id"), F.lit(1 << 20))
    total = claims.count()
    blocks = max(1, -(-total // block))
    b = claims.where("claim_id IS NOT NULL AND statement IS NOT NULL").select(F.pmod(at, F.lit(blocks)).alias("block"), F.struct("claim_id", line.alias("line")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    ask = "Name pairs of claims that say the same, contradict or support one another, as JSON {\"same\": [[a, b]], \"contradicts\": [], \"supports\": []}.\n\n"
    return b.groupBy("block").agg(F.concat(F.lit(ask), text).alias("prompt"))


def pair_prompts(claims: DataFrame, pairs: DataFrame, block: int = 25) -> DataFrame:
    """``block, prompt``: prompts that ask about candidate pairs (claim_a, claim_b), ``block`` pairs or so in each.

    Every pair is asked about once, wherever its claims are; candidates come from a similarity join or shared support,
    so that a large ledger is not asked about all pairs.
    """
    line = F.format_string("[%s] (credence %.2f) %s", F.col("claim_id"), F.col("score"), F.col("statement"))
    said = claims.where("claim_id IS NOT NULL AND statement IS NOT NULL").select("claim_id", line.alias("line"))
    p = pairs.where("claim_a <> claim_b").select(F.least("claim_a", "claim_b").alias("claim_a"), F.greatest("claim_a", "claim_b").alias("claim_b")).distinct()
    blocks = max(1, -(-p.count() // block))
    p = p.join(said.withColumnsRenamed({"claim_id": "claim_a", "line": "a"}), "claim_a").join(said.withColumnsRenamed({"claim_id": "claim_b", "line": "b"}), "claim_b")
    both = F.concat("a", F.lit("\n"), "b")
    p = p.select(F.pmod(F.xxhash64("claim_a", "claim_b"), F.lit(blocks)).alias("block"), F.struct("claim_a", "claim_b", both.alias("text")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n\n")
    ask = "For each pair of claims say whether they are the same, contradict or support one another, as JSON {\"same\": [[a, b]], \"contradicts\": [], \"supports\": []}.\n\n"
    return p.groupBy("block").agg(F.concat(F.lit(ask), text).alias("prompt"))


def same_groups(pairs: DataFrame) -> DataFrame:
    """``node, group_id`` of claims linked by pairs (claim_a, claim_b), directly or through others; group_id is the smallest.

    For as many pairs as a revision may hold (graph.KERNEL_EDGES, counted; more are an error, for which the subpackage
    for training data has an operator without a bound).
    """
    spark = pairs.sparkSession
    both = pairs.where("claim_a <> claim_b").select(F.explode(F.array(F.struct("claim_a", "claim_b"), F.struct(F.col("claim_b").alias("claim_a"), F.col("claim_a").alias("claim_b")))).alias("e")).select("e.*")
    g = graph.lineage(both, "claim_a", "claim_b")
    if g is None:
        raise ValueError(f"more than {graph.KERNEL_EDGES} links")
    table = pa.table({"node": g["names"].cast(pa.string()), "group": pa.array(g["group"])})
    nodes = spark.createDataFrame(table, "node string, group long") if len(table) else spark.createDataFrame([], "node string, group long")
    return nodes.join(nodes.groupBy("group").agg(F.min("node").alias("group_id")), "group").select("node", "group_id")


def consolidation_pass(replies: DataFrame, text: str, claims: DataFrame, known: DataFrame, t: str, *, actor: str = "consolidator", groups: DataFrame | None = None) -> DataFrame:
    """``t, actor, type, payload``: what the replies of a model to prompts become, as rows for a log.

    Pairs of live claims (claim_id, topic) only.  Same claims get the topic of their group unless they have one (groups
    as in same_groups, which makes them if they are not given); contradictions are declared unless ``known`` (claim_a,
    claim_b) has them in either order; support is only proposed, as a record that no fold reads.
    """
    pairs = known_pairs(parse_relations(replies, text), claims).distinct()
    groups = same_groups(pairs.where("relation = 'same'")) if groups is None else groups
    given = audit.topics(groups, claims).select(F.lit("topic_assigned").alias("type"), F.to_json(F.struct("claim_id", "topic")).alias("payload"))
    order = [F.least("claim_a", "claim_b").alias("claim_a"), F.greatest("claim_a", "claim_b").alias("claim_b")]
    clash = pairs.where("relation = 'contradicts'").select(*order).distinct().join(known.select(*order).distinct(), ["claim_a", "claim_b"], "left_anti")
    said = clash.select(F.lit("contradiction").alias("type"), F.to_json(F.struct("claim_a", "claim_b", F.lit(0.1).alias("p_loser_given_winner"))).alias("payload"))
    maybe = pairs.where("relation = 'supports'").select(F.lit("support_proposed").alias("type"), F.to_json(F.struct(F.col("claim_a").alias("supports_id"), F.col("claim_b").alias("claim_id"))).alias("payload"))
    return given.unionByName(said).unionByName(maybe).select(F.lit(t).alias("t"), F.lit(actor).alias("actor"), "type", "payload")


def parse_relations(replies: DataFrame, text: str) -> DataFrame:
    """``relation, claim_a, claim_b``: pairs of two different ids from the outermost braces of each reply; anything else is dropped."""
    body = F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0)
    doc = F.from_json(body, ", ".join(f"{r} array<array<string>>" for r in RELATIONS))
    none = F.array().cast("array<struct<relation:string,p:array<string>>>")

    def of(relation: str) -> Column:
        return F.coalesce(F.transform(doc[relation], lambda p: F.struct(F.lit(relation).alias("relation"), p.alias("p"))), none)

    rows = F.flatten(F.array(*map(of, RELATIONS)))
    out = replies.select(F.explode(rows).alias("r")).select("r.relation", F.col("r.p").alias("p")).where((F.size("p") == 2))
    return out.select("relation", F.col("p")[0].alias("claim_a"), F.col("p")[1].alias("claim_b")).where("claim_a <> claim_b")


def known_pairs(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Pairs whose two ids are live claims."""
    ids = claims.select("claim_id").distinct()
    p = pairs.join(ids.withColumnRenamed("claim_id", "claim_a"), "claim_a", "left_semi")
    return p.join(ids.withColumnRenamed("claim_id", "claim_b"), "claim_b", "left_semi")


def topic(group_id: Column) -> Column:
    """The topic of a group of same claims, by its smallest id."""
    return F.concat(F.lit("prop:"), group_id)
