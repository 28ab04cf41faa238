"""Queries of the training-data operators and their SQL equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefloom.functions.text import plain
from beliefloom.llm.components import components
from beliefloom.llm.contamination import leaks
from beliefloom.llm.neardup import near_groups
from beliefloom.llm.packing import CAPACITY, DOCS, pack, packing_report
from beliefloom.llm.residue import residue
from beliefloom.llm.splits import split_overlaps
from beliefloom.operators.audit import topics
from beliefloom.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidator's same-verdicts between two different known claims."""
    known = table(spark, sf_dir, "claims").select("claim_id").where("claim_id IS NOT NULL").distinct()
    rel = table(spark, sf_dir, "claim_relations").where(plain(F.col("relation")) == "same").select("claim_a", "claim_b")
    rel = rel.where("claim_a <> claim_b").select(F.least("claim_a", "claim_b").alias("claim_a"), F.greatest("claim_a", "claim_b").alias("claim_b")).distinct()
    rel = rel.join(known.withColumnRenamed("claim_id", "claim_a"), "claim_a", "left_semi")
    return rel.join(known.withColumnRenamed("claim_id", "claim_b"), "claim_b", "left_semi")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(same_pairs(spark, sf_dir), "claim_a", "claim_b").select(F.col("node").alias("claim_id"), "group_id")


def p1_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_claims"))


def p1_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic that each member of a group of same claims gets."""
    groups = components(same_pairs(spark, sf_dir), "claim_a", "claim_b")
    none = spark.createDataFrame([], "claim_id string, topic string")
    return topics(groups, none)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "claims"), "claim_id", "statement", 0.6)


def eval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, prop_id, field, pos, text of both evaluation splits."""
    out = None
    for split in ("dev", "heldout"):
        t = table(spark, sf_dir, f"lora02_{split}")
        key = [F.lit(split).alias("split"), "prop_id"]
        rows = t.select(*key, F.lit("statement").alias("field"), F.lit(0).alias("pos"), F.col("statement").alias("text"))
        for field in ("assert", "deny"):
            rows = rows.unionByName(t.select(*key, F.lit(field).alias("field"), F.posexplode(field).alias("pos", "text")))
        out = rows if out is None else out.unionByName(rows)
    return out


def train_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lora02_train")
    return t.select("example_id", F.col("source").alias("train_source"), F.explode(F.array("sentence", "fact")).alias("text"))


def p6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap with its likeness and the part of the longer text that shared chunks cover."""
    return split_overlaps(
        eval_texts(spark, sf_dir), ["split", "prop_id", "field", "pos"], train_texts(spark, sf_dir), ["example_id", "train_source"], "text", 0.7
    )


def p6_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap with its likeness in millionths."""
    return p6_overlaps(spark, sf_dir).drop("overlap").withColumn("likeness", F.floor(F.col("likeness") * 1000000)).withColumnRenamed("likeness", "likeness_ppm")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_overlaps(spark, sf_dir).select("split", "prop_id", "field", "pos", "example_id").distinct()


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split and training source: cases, propositions and training rows concerned."""
    return p6_overlaps(spark, sf_dir).groupBy("split", "train_source").agg(
        F.count("*").alias("n_cases"), F.countDistinct("prop_id").alias("n_props"), F.countDistinct("example_id").alias("n_examples")
    )


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p7_packed(spark, sf_dir))


def p7_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing under an attention budget of half a full sequence, which binds for combined pieces."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", max_cost=CAPACITY**2 / 2)


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of both packings: documents placed, and how often a limit is broken (sequences over tokens, pieces or cost; gaps; needless splits)."""
    out = None
    for name, packed, cost in (("p7_packed", p7_packed(spark, sf_dir), CAPACITY**2), ("p7_balanced", p7_balanced(spark, sf_dir), CAPACITY**2 / 2)):
        packed = cut(packed)
        per = packed.where("sequence IS NOT NULL").groupBy("sequence").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("c"))
        over = per.agg(*(F.count_if(c).alias(n) for n, c in (("n_over_tokens", F.col("t") > CAPACITY), ("n_over_pieces", F.col("k") > DOCS), ("n_over_cost", (F.col("c") > cost) & (F.col("k") > 1)))))
        whole = packed.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"), F.max("start").alias("last"), F.max("piece").alias("p"), F.max_by("n_tokens", "piece").alias("rest"))
        bad = (F.col("k") != F.greatest(F.ceil(F.col("t") / CAPACITY), F.lit(1))) | (F.col("p") != F.col("k") - 1) | (F.col("last") + F.col("rest") != F.col("t"))
        docs = whole.agg(F.count("*").alias("n_docs"), F.count_if(bad).alias("n_torn"))
        row = docs.unionByName(over, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in ("n_docs", "n_torn", "n_over_tokens", "n_over_pieces", "n_over_cost"))).select(F.lit(name).alias("packing"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which passages stand in them, verbatim or with a few word edits."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages")
    return leaks(docs, "doc_id", "text", items, "item_id", "text").withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where("longest >= 12").select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items of each suite with the number of documents they stand in."""
    items = table(spark, sf_dir, "eval_passages").select("item_id", "suite")
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs")).join(items, "item_id").select("suite", "item_id", "n_docs")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what was found in it."""
    return residue(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_report(spark, sf_dir).where("residue").select("doc_id")


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each kind that stay after residue is excluded, and those excluded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "doc_kind")
    out = docs.join(p9_report(spark, sf_dir).select("doc_id", "residue"), "doc_id").groupBy("doc_kind")
    return out.agg(F.sum(F.when(F.col("residue"), 0).otherwise(1)).alias("n_kept"), F.sum(F.when(F.col("residue"), 1).otherwise(0)).alias("n_excluded"))


QUERIES = {
    "p1_found": p1_found, "p1_group_sizes": p1_group_sizes, "p1_topics": p1_topics, "p2_found": p2_found,
    "p6_found": p6_found, "p6_overlaps": p6_overlaps, "p6_likeness": p6_likeness, "p6_counts": p6_counts,
    "p7_packed": p7_packed, "p7_balanced": p7_balanced, "p7_limits": p7_limits, "p7_report": p7_report, "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items,
    "p9_found": p9_found, "p9_report": p9_report, "p9_kept": p9_kept,
}

_GROUPS = r"""
pr AS (SELECT DISTINCT claim_a AS a, claim_b AS b FROM claim_relations
    WHERE lower(regexp_replace(relation, '^\s+|\s+$', '', 'g')) = 'same' AND claim_a <> claim_b
    AND claim_a IN (SELECT claim_id FROM claims) AND claim_b IN (SELECT claim_id FROM claims)),
arc AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
lab(id, low) USING KEY (id) AS (
    SELECT a, least(a, min(b)) FROM arc GROUP BY a
    UNION SELECT r.a, min(l.low) FROM lab l JOIN arc r ON r.b = l.id JOIN recurring.lab c ON c.id = r.a WHERE l.low < c.low GROUP BY r.a)
"""

_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

_NEAR = f"""
s AS (SELECT row_number() OVER () AS sid, claim_id, list_distinct({_W.format('statement')}) AS ws FROM (SELECT DISTINCT claim_id, statement FROM claims WHERE statement IS NOT NULL AND claim_id IS NOT NULL)),
tk AS (SELECT sid, claim_id, len(ws) AS n, unnest(ws) AS w FROM s),
pr AS (SELECT a.claim_id AS a, b.claim_id AS b FROM tk a JOIN tk b ON a.w = b.w AND a.sid < b.sid WHERE a.claim_id <> b.claim_id
    GROUP BY a.sid, b.sid, a.claim_id, b.claim_id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9),
""" + _GROUPS[_GROUPS.index("arc AS"):]

_SPLITS = f"""
ev AS (SELECT split, prop_id, field, pos, text FROM (
    SELECT 'dev' AS split, prop_id, 'statement' AS field, 0 AS pos, statement AS text FROM lora02_dev UNION ALL SELECT 'heldout', prop_id, 'statement', 0, statement FROM lora02_heldout
    UNION ALL SELECT 'dev', prop_id, 'assert', unnest(range(len("assert"))), unnest("assert") FROM lora02_dev UNION ALL SELECT 'heldout', prop_id, 'assert', unnest(range(len("assert"))), unnest("assert") FROM lora02_heldout
    UNION ALL SELECT 'dev', prop_id, 'deny', unnest(range(len(deny))), unnest(deny) FROM lora02_dev UNION ALL SELECT 'heldout', prop_id, 'deny', unnest(range(len(deny))), unnest(deny) FROM lora02_heldout) WHERE text IS NOT NULL),
tr AS (SELECT DISTINCT example_id, source, unnest([sentence, fact]) AS text FROM lora02_train),
es AS (SELECT *, list_distinct({_W.format('text')}) AS ws FROM (SELECT row_number() OVER () AS eid, * FROM ev)),
ts AS (SELECT *, list_distinct({_W.format('text')}) AS ws FROM (SELECT row_number() OVER () AS tid, * FROM tr WHERE text IS NOT NULL)),
et AS (SELECT eid, len(ws) AS n, unnest(ws) AS w FROM es), tt AS (SELECT tid, len(ws) AS n, unnest(ws) AS w FROM ts),
hit AS (SELECT eid, tid, count(*) / (et.n + tt.n - count(*)) AS likeness FROM et JOIN tt USING (w) GROUP BY eid, tid, et.n, tt.n HAVING count(*) >= 0.7 * (et.n + tt.n - count(*)) - 1e-9),
cases AS (SELECT DISTINCT split, prop_id, field, pos::INTEGER AS pos, example_id, source AS train_source FROM hit JOIN es USING (eid) JOIN ts USING (tid))
"""

_LEAKS = f"""
d AS (SELECT doc_id, {_W.format('text')} AS ws FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, suite, {_W.format('text')} AS ws FROM eval_passages WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(ws[k:k + 11], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM d WHERE len(ws) >= 12)),
iw AS (SELECT item_id, suite, array_to_string(ws[k:k + 11], ' ') AS win FROM (SELECT item_id, suite, ws, unnest(range(1, len(ws) - 10)) AS k FROM i WHERE len(ws) >= 12)),
leak AS (SELECT DISTINCT doc_id, item_id, suite FROM dw JOIN iw USING (win))
"""

ORACLES = {
    "p1_found": f"WITH RECURSIVE {_GROUPS} SELECT id AS claim_id, low AS group_id FROM lab",
    "p1_group_sizes": f"WITH RECURSIVE {_GROUPS} SELECT low AS group_id, count(*) AS n_claims FROM lab GROUP BY low",
    "p1_topics": f"WITH RECURSIVE {_GROUPS} SELECT id AS claim_id, 'prop:' || low AS topic FROM lab",
    "p2_found": f"WITH RECURSIVE {_NEAR} SELECT id AS claim_id, low AS group_id FROM lab",
    "p6_found": f"WITH {_SPLITS} SELECT DISTINCT split, prop_id, field, pos, example_id FROM cases",
    "p6_counts": f"""WITH {_SPLITS} SELECT split, train_source, count(*) AS n_cases, count(DISTINCT prop_id) AS n_props, count(DISTINCT example_id) AS n_examples FROM cases
        GROUP BY split, train_source""",
    "p6_likeness": f"""WITH {_SPLITS} SELECT split, prop_id, field, pos::INTEGER AS pos, example_id, source AS train_source, max(floor(likeness * 1000000)::BIGINT) AS likeness_ppm
        FROM hit JOIN es USING (eid) JOIN ts USING (tid) GROUP BY ALL""",
    "p7_limits": """SELECT packing, count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS n_torn, 0::BIGINT AS n_over_tokens, 0::BIGINT AS n_over_pieces, 0::BIGINT AS n_over_cost
        FROM documents, (VALUES ('p7_packed'), ('p7_balanced')) AS x(packing) WHERE doc_id IS NOT NULL GROUP BY packing""",
    "p8_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM leak",
    "p8_items": f"WITH {_LEAKS} SELECT suite, item_id, count(DISTINCT doc_id) AS n_docs FROM leak GROUP BY suite, item_id",
}
