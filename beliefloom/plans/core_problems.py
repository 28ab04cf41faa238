"""Queries of the data-processing problems that belong to the core: hierarchies, change feeds, as-of attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefloom.functions.text import claim_key, instant_us, plain
from beliefloom.operators.changefeed import apply_changes
from beliefloom.operators.hierarchy import cycle_members, descendants, hierarchy
from beliefloom.operators.temporal import asof_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deductive_links(edges: DataFrame) -> DataFrame:
    """Live deductive support edges with canonical ids: child, parent."""
    live = (plain(F.col("kind")) == "deductive") & (F.col("txn_to").isNull() | (F.col("txn_to") == ""))
    return edges.where(live).select(claim_key(F.col("claim_id")).alias("child"), claim_key(F.col("supports_id")).alias("parent"))


def support_tree(spark: SparkSession, sf_dir: str, paths: bool = False) -> DataFrame:
    return hierarchy(deductive_links(table(spark, sf_dir, "support_edges")), "child", "parent", paths=paths)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = support_tree(spark, sf_dir)
    return t.select(F.col("node").alias("claim_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = support_tree(spark, sf_dir, paths=True)
    return t.select(
        F.col("node").alias("claim_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"),
        F.array_join("path", ">").alias("path"),
    )


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = descendants(support_tree(spark, sf_dir, paths=True))
    return d.select(F.col("ancestor").alias("claim_id"), F.col("node").alias("descendant_id"), F.col("distance").cast("int").alias("distance"))


def p3_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle_members(support_tree(spark, sf_dir)).select(F.col("cycle").alias("root_id"), F.col("nodes").cast("long").alias("n_claims"))


def claim_changes(records: DataFrame) -> DataFrame:
    """The distinct changes of a store's claims: store, claim_id, seq, op, score, content.

    ``content`` is a digest of what makes two changes the same.

    Rows alike in store, instant, actor, type and payload content are one change at its lowest seq; content is
    compared as parsed JSON (sorted keys, no escapes), torn payloads do not parse and do not count.
    """
    kinds = ("assert", "score_revision", "claim_status_changed", "supersede")
    r = records.select("store", "seq", "t", "actor", "type", "payload").where(F.col("type").isin(*kinds))
    r = r.withColumn("doc", F.try_parse_json("payload")).where("doc IS NOT NULL")
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    r = r.select(
        "store", "seq", F.coalesce(instant_us(F.col("t")).cast("string"), F.col("t")).alias("at"), "actor", "type",
        F.md5(F.to_json("doc")).alias("content"),
        F.when(F.col("type") == "supersede", get("$.old_claim_id", "string")).otherwise(get("$.claim_id", "string")).alias("claim_id"),
        F.when(F.col("type") == "assert", get("$.prior", "double")).when(F.col("type") == "score_revision", get("$.new_score", "double")).alias("score"),
    )
    same = ["store", "at", "actor", "type", "content"]
    r = r.groupBy(*same).agg(F.min("seq").alias("seq"), F.min("claim_id").alias("claim_id"), F.min("score").alias("score"))
    op = F.when(F.col("type") == "assert", "insert").when(F.col("type") == "score_revision", "update").otherwise("delete")
    return r.select("store", "claim_id", "seq", op.alias("op"), "score", F.md5(F.concat_ws("\u0001", "at", "actor", "type", "content")).alias("content"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = apply_changes(claim_changes(table(spark, sf_dir, "ledger_records")), ["store", "claim_id"], "seq", "op", ["score"])
    return live.select("store", "claim_id", F.round(F.col("score") * 10000).cast("int").alias("score_bp"))


def p4_live_per_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live claims of each store after the replay, with the sum of their scores in basis points."""
    return p4_found(spark, sf_dir).groupBy("store").agg(F.count("*").alias("n_live"), F.sum("score_bp").cast("long").alias("sum_bp"))


def score_versions(claims: DataFrame) -> DataFrame:
    """claim_id, from_us, to_us (the earliest end of the version's rows, null if none), score."""
    c = claims.select("claim_id", instant_us(F.col("txn_from")).alias("from_us"), instant_us(F.col("txn_to")).alias("to_us"), "score")
    return c.where("claim_id IS NOT NULL AND from_us IS NOT NULL").groupBy("claim_id", "from_us").agg(F.min("to_us").alias("to_us"), F.min("score").alias("score"))


def scored_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "outcomes").select("claim_id", instant_us(F.col("t")).alias("t_us"), "outcome")
    hit = asof_join(
        out, score_versions(table(spark, sf_dir, "claims")), key="claim_id", event_time="t_us", version_time="from_us",
        attributes=["to_us", "score"], version_as="from_us_known",
    )
    return hit.where("to_us IS NULL OR to_us > t_us").withColumnRenamed("from_us_known", "from_us")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_outcomes(spark, sf_dir).select("claim_id", "t_us", "from_us").distinct()


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cases with the score known then, in basis points, and the number of outcomes that read 1 and 0."""
    s = scored_outcomes(spark, sf_dir)
    return s.groupBy("claim_id", "t_us", "from_us").agg(
        F.round(F.min("score") * 10000).cast("int").alias("score_bp"),
        F.sum(F.when(F.col("outcome") == 1, 1).otherwise(0)).cast("long").alias("n_true"),
        F.sum(F.when(F.col("outcome") == 0, 1).otherwise(0)).cast("long").alias("n_false"),
    )


QUERIES = {
    "p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_cycles": p3_cycles,
    "p4_found": p4_found, "p4_live_per_store": p4_live_per_store, "p5_found": p5_found, "p5_scores": p5_scores,
}

_LINKS = r"""
lnk AS (SELECT c, min(p) AS p FROM (
    SELECT upper(c0[1]) || c0[2:] AS c, upper(p0[1]) || p0[2:] AS p FROM (
        SELECT lower(regexp_replace(claim_id, '^\s+|\s+$', '', 'g')) AS c0, lower(regexp_replace(supports_id, '^\s+|\s+$', '', 'g')) AS p0
        FROM support_edges
        WHERE lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) = 'deductive' AND (txn_to IS NULL OR txn_to = ''))
    WHERE c0 <> '' AND p0 <> '') GROUP BY c),
ids AS (SELECT c AS id FROM lnk UNION SELECT p FROM lnk),
tree AS (
    SELECT id, id AS root, 0 AS depth, id AS path FROM ids WHERE id NOT IN (SELECT c FROM lnk)
    UNION ALL SELECT l.c, t.root, t.depth + 1, t.path || '>' || l.c FROM tree t JOIN lnk l ON l.p = t.id),
lost AS (SELECT * FROM lnk WHERE c NOT IN (SELECT id FROM tree)),
reach AS (SELECT c AS id, p AS up FROM lost UNION SELECT r.id, l.p FROM reach r JOIN lost l ON l.c = r.up),
ring AS (SELECT id FROM reach WHERE id = up),
nodes AS (
    SELECT id AS claim_id, root AS root_id, depth, path FROM tree
    UNION ALL SELECT r.id, min(r.up), -1, NULL FROM reach r JOIN ring g ON g.id = r.up GROUP BY r.id)
"""


def _us(c: str) -> str:
    return (
        f"epoch_us(TRY_CAST(CASE WHEN length(trim({c})) = 10 THEN trim({c}) || 'T00:00:00Z' "
        f"WHEN regexp_matches(trim({c}), '(?:[Zz]|[+-]\\d{{2}}:?\\d{{2}})$') THEN trim({c}) ELSE trim({c}) || 'Z' END AS TIMESTAMPTZ))"
    )


_VERSIONS = f"""
ver AS (SELECT claim_id, from_us, min(to_us) AS to_us, min(score) AS score FROM (
    SELECT claim_id, {_us('txn_from')} AS from_us, {_us('txn_to')} AS to_us, score FROM claims) GROUP BY ALL),
cases AS (SELECT o.claim_id, o.t_us, o.outcome, v.from_us, v.score FROM (
    SELECT claim_id, {_us('t')} AS t_us, outcome FROM outcomes) o ASOF JOIN ver v ON o.claim_id = v.claim_id AND o.t_us >= v.from_us
    WHERE v.to_us IS NULL OR v.to_us > o.t_us)
""".replace("GROUP BY ALL", "GROUP BY claim_id, from_us")

_LIVE = f"""
rec AS (SELECT store, seq, coalesce({_us('t')}::VARCHAR, t) AS t_at, actor, type, payload::JSON AS j FROM ledger_records
    WHERE type IN ('assert', 'score_revision', 'claim_status_changed', 'supersede') AND json_valid(payload)),
chg AS (SELECT store, type, min(seq) AS seq, claim_id, max(score) AS score FROM (
    SELECT store, seq, t_at, actor, type,
        CASE WHEN type = 'supersede' THEN j->>'old_claim_id' ELSE j->>'claim_id' END AS claim_id,
        CASE WHEN type = 'assert' THEN (j->>'prior')::DOUBLE WHEN type = 'score_revision' THEN (j->>'new_score')::DOUBLE END AS score,
        concat_ws('|', coalesce(j->>'claim_id', '~'), coalesce(j->>'prior', '~'), coalesce(j->>'statement', '~'), coalesce(j->>'writer', '~'),
            coalesce(j->>'critical', '~'), coalesce(j->>'entrenchment', '~'), coalesce(j->>'materiality', '~'), coalesce(j->>'score_kind', '~'),
            coalesce(j->>'new_score', '~'), coalesce(j->>'old_score', '~'), coalesce(j->>'triggering_event_id', '~'), coalesce(j->>'status', '~'),
            coalesce(j->>'reason', '~'), coalesce(j->>'source', '~'), coalesce(j->>'old_claim_id', '~'), coalesce(j->>'new_claim_id', '~')) AS content
    FROM rec) GROUP BY store, t_at, actor, type, content, claim_id),
st AS (SELECT store, claim_id, max(seq) AS s, arg_max(type, seq) AS last, arg_max(coalesce(score, -1), seq) AS prior FROM chg
    WHERE type <> 'score_revision' GROUP BY store, claim_id),
live AS (SELECT st.store, st.claim_id, round(coalesce(arg_max(c.score, c.seq), any_value(st.prior)) * 10000)::INTEGER AS score_bp
    FROM st LEFT JOIN chg c ON c.store = st.store AND c.claim_id = st.claim_id AND c.type = 'score_revision' AND c.seq > st.s
    WHERE st.last = 'assert' GROUP BY st.store, st.claim_id)
"""

ORACLES = {
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT claim_id, root_id, depth::INTEGER AS depth FROM nodes",
    "p3_paths": f"WITH RECURSIVE {_LINKS} SELECT claim_id, root_id, depth::INTEGER AS depth, path FROM nodes",
    "p3_descendants": f"""WITH RECURSIVE {_LINKS},
        pairs AS (SELECT p AS claim_id, c AS descendant_id, 1 AS distance FROM lnk WHERE c IN (SELECT id FROM tree)
            UNION ALL SELECT a.claim_id, l.c, a.distance + 1 FROM pairs a JOIN lnk l ON l.p = a.descendant_id)
        SELECT claim_id, descendant_id, distance::INTEGER AS distance FROM pairs""",
    "p3_cycles": f"WITH RECURSIVE {_LINKS} SELECT root_id, count(*) AS n_claims FROM nodes WHERE depth = -1 GROUP BY root_id",
    "p4_found": f"WITH {_LIVE} SELECT store, claim_id, score_bp FROM live",
    "p4_live_per_store": f"WITH {_LIVE} SELECT store, count(*) AS n_live, sum(score_bp)::BIGINT AS sum_bp FROM live GROUP BY store",
    "p5_found": f"WITH {_VERSIONS} SELECT DISTINCT claim_id, t_us, from_us FROM cases",
    "p5_scores": f"""WITH {_VERSIONS} SELECT claim_id, t_us, from_us, round(min(score) * 10000)::INTEGER AS score_bp,
        sum(CASE WHEN outcome = 1 THEN 1 ELSE 0 END)::BIGINT AS n_true, sum(CASE WHEN outcome = 0 THEN 1 ELSE 0 END)::BIGINT AS n_false
        FROM cases GROUP BY claim_id, t_us, from_us""",
}
