"""Queries of audits, revision and belief arithmetic, with their SQL; some over tables into which faults are put."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefloom.functions import belief as B
from beliefloom.functions.text import plain
from beliefloom.operators import audit, chain, contradict, fold, graph, history, revision
from beliefloom.plans.core_problems import table
from beliefloom.plans.reference import QUERIES, _HASHED, _HIST, _IV, _MERKLE, _REACH, _REC, _VER, edges, hist, hub, intervals, log, query, revise_sql
from beliefloom.sources.logs import PAYLOAD, record_at

# ---- belief arithmetic -----------------------------------------------------------------------------------------------


def _masses(spark: SparkSession, sf: str, side: int) -> DataFrame:
    """A mass function over three elements for each customer with orders on that side."""
    o = table(spark, sf, "orders").where(F.col("o_orderkey") % 2 == side)
    m = o.groupBy("o_custkey", (1 + F.col("o_orderkey") % 7).alias("subset")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("m"))
    return m.join(m.groupBy("o_custkey").agg(F.sum("m").alias("t")), "o_custkey").select("o_custkey", "subset", (F.col("m") / F.col("t")).alias("mass"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey % 2 AS side, 1 + o_orderkey % 7 AS subset, sum(o_totalprice::DOUBLE) AS m FROM orders GROUP BY ALL),
    n AS (SELECT *, m / sum(m) OVER (PARTITION BY o_custkey, side) AS mass FROM o),
    j AS (SELECT a.o_custkey, a.subset & b.subset AS subset, sum(a.mass * b.mass) AS mass FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND a.side = 0 AND b.side = 1 GROUP BY 1, 2),
    c AS (SELECT o_custkey, sum(CASE WHEN subset = 0 THEN mass ELSE 0 END) AS conflict FROM j GROUP BY 1)
    SELECT o_custkey, subset, round(mass / (1 - conflict), 6) AS mass, round(conflict, 6) AS conflict FROM j JOIN c USING (o_custkey) WHERE subset <> 0 AND conflict < 1 - 1e-12
    UNION ALL SELECT o_custkey, NULL, NULL, round(conflict, 6) FROM c WHERE conflict >= 1 - 1e-12""")
def dempster_nary(spark, sf):
    out = B.dempster(_masses(spark, sf, 0), _masses(spark, sf, 1), ["o_custkey"])
    return out.select("o_custkey", "subset", F.round("mass", 6).alias("mass"), F.round("conflict", 6).alias("conflict"))


@query(f"WITH {_IV} SELECT claim_id, round(b, 6) AS on_true, round(1 - p, 6) AS on_false, round(p - b, 6) AS on_either FROM iv")
def interval_masses(spark, sf):
    m = intervals(spark, sf).select("claim_id", B.interval_to_mass(F.col("belief"), F.col("plausibility")).alias("m"))
    return m.select("claim_id", F.round("m.true", 6).alias("on_true"), F.round("m.false", 6).alias("on_false"), F.round("m.either", 6).alias("on_either"))


@query("""WITH o AS (SELECT o_orderkey, greatest(0.01, least(0.99, (o_orderkey % 100) / 100)) AS p, o_orderstatus = 'F' AS yes, (60 + 5 * (o_custkey % 8)) / 100 AS a FROM orders),
    x AS (SELECT o_orderkey, p / (1 - p) * pow(CASE WHEN yes THEN a / (1 - a) ELSE (1 - a) / a END, 0.5) AS odds FROM o) SELECT o_orderkey, round(odds / (1 + odds), 6) AS posterior FROM x""")
def bayes_posterior(spark, sf):
    o = table(spark, sf, "orders")
    a = (60 + 5 * (F.col("o_custkey") % 8)) / 100
    return o.select("o_orderkey", F.round(B.bayes_update((F.col("o_orderkey") % 100) / 100, F.col("o_orderstatus") == "F", a, 0.5), 6).alias("posterior"))


@query("""SELECT o_orderkey, p::DOUBLE AS p_given, q::DOUBLE AS p_given_not, p < q AS counter FROM (SELECT o_orderkey,
    CASE o_orderpriority WHEN '1-URGENT' THEN 0.95 WHEN '2-HIGH' THEN 0.7 WHEN '3-MEDIUM' THEN 0.5 WHEN '5-LOW' THEN 0.05 END AS p, CASE o_orderstatus WHEN 'F' THEN 0.15 WHEN 'O' THEN 0.85 END AS q FROM orders)""")
def elicited_pairs(spark, sf):
    first = F.create_map(*[F.lit(x) for x in ("1-URGENT", "almost certain", "2-HIGH", "Likely ", "3-MEDIUM", "toss-up", "5-LOW", "almost impossible")])
    then = F.create_map(*[F.lit(x) for x in ("F", "very unlikely", "O", "very likely")])
    p = table(spark, sf, "orders").select("o_orderkey", B.elicit_pair(first[F.col("o_orderpriority")], then[F.col("o_orderstatus")]).alias("e"))
    return p.select("o_orderkey", "e.*")


@query("""SELECT l_suppkey AS source, count(*) AS total, count(*) FILTER (l_returnflag = 'N') AS correct, round((10 * 0.8 + count(*) FILTER (l_returnflag = 'N')) / (10 + count(*)), 9) AS accuracy FROM lineitem GROUP BY l_suppkey""")
def source_trust(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "N").alias("correct"))
    return n.withColumn("accuracy", F.round(B.trust(F.lit(0.8), F.col("correct"), F.col("total")), 9))


# ---- registers -------------------------------------------------------------------------------------------------------


def writer_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log in which customers are writers: most are registered, pending orders give them a new tier, every order asserts a claim."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    tier = lambda k: F.element_at(F.array(F.lit("owner"), F.lit("contributor"), F.lit("provisional")), (1 + k % 3).cast("int"))
    first = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("long").alias("seq"), F.lit("writer_registered").alias("type"), F.to_json(F.struct(F.concat(F.lit("w"), "c_custkey").alias("writer_id"), tier(F.col("c_custkey")).alias("tier"))).alias("payload"))
    again = o.where("o_orderstatus = 'P'").select((1_000_000_000 + 2 * F.col("o_orderkey").cast("long")).alias("seq"), F.lit("writer_registered").alias("type"), F.to_json(F.struct(F.concat(F.lit("w"), "o_custkey").alias("writer_id"), tier(F.col("o_orderkey")).alias("tier"))).alias("payload"))
    who = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("w"), "o_custkey"))
    claims = o.select((1_000_000_001 + 2 * F.col("o_orderkey").cast("long")).alias("seq"), F.lit("assert").alias("type"), F.to_json(F.struct(F.concat(F.lit("C"), "o_orderkey").alias("claim_id"), who.alias("writer"), F.lit(0.5).alias("prior"))).alias("payload"))
    rows = first.unionByName(again).unionByName(claims).select(F.lit("orders").alias("store"), "seq", F.lit("2024-01-01T00:00:00Z").alias("t"), "type", "payload")
    return rows.withColumns({"t_us": F.lit(1_704_067_200_000_000), "p": F.from_json("payload", PAYLOAD)})


_TIER = "(['owner', 'contributor', 'provisional'])[1 + ({} % 3)]"
_WRITERS = f"""reg AS (SELECT 'w' || c_custkey AS writer, c_custkey::BIGINT AS seq, {_TIER.format('c_custkey')} AS tier FROM customer WHERE c_custkey % 4 <> 0
    UNION ALL SELECT 'w' || o_custkey, 1000000000 + 2 * o_orderkey, {_TIER.format('o_orderkey')} FROM orders WHERE o_orderstatus = 'P'),
asks AS (SELECT 'C' || o_orderkey AS claim_id, 1000000001 + 2 * o_orderkey AS seq, CASE WHEN o_orderkey % 5 <> 0 THEN 'w' || o_custkey END AS writer FROM orders),
had AS (SELECT a.claim_id, a.seq, a.writer, r.tier FROM asks a ASOF LEFT JOIN reg r ON a.writer = r.writer AND a.seq >= r.seq)"""


@query(f"WITH {_WRITERS} SELECT claim_id, CASE WHEN writer IS NULL THEN 5000 WHEN tier = 'owner' THEN 7500 WHEN tier = 'contributor' THEN 5000 ELSE 2500 END AS ent_bp FROM had")
def entrenchment_by_tier(spark, sf):
    """What claims get that are asserted without an entrenchment: by their writer's tier at that moment."""
    v = fold.claim_versions(writer_log(spark, sf))
    return v.select("claim_id", F.round(F.col("entrenchment") * 10000).cast("int").alias("ent_bp"))


@query(f"WITH {_WRITERS} SELECT claim_id, writer, tier FROM had WHERE writer IS NOT NULL")
def writers_at_event_time(spark, sf):
    lg = writer_log(spark, sf)
    asks = lg.where("type = 'assert'").select("store", "seq", F.col("p.claim_id").alias("claim_id"), F.col("p.writer").alias("writer")).where("writer IS NOT NULL")
    return fold.lookup(lg, "writers", asks, "writer").select("claim_id", "writer", "tier")


@query(f"""WITH {_WRITERS}, last AS (SELECT writer, arg_max(tier, seq) AS tier FROM reg GROUP BY writer)
    SELECT 'w' || c_custkey AS writer_id, coalesce(tier, 'unregistered') AS tier FROM customer LEFT JOIN last ON writer = 'w' || c_custkey""")
def writers_now(spark, sf):
    ids = table(spark, sf, "customer").select(F.lit("orders").alias("store"), F.concat(F.lit("w"), "c_custkey").alias("writer_id"))
    return fold.accessor(writer_log(spark, sf), "writers", ids, "writer_id", {"tier": "unregistered"}).select("writer_id", "tier")


# ---- contradictions --------------------------------------------------------------------------------------------------


def contradiction_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of contradictions, one per order: declared, held, and resolved or dismissed by its returned lines."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    pair = [F.concat(F.lit("C"), "o_custkey").alias("claim_a"), F.concat(F.lit("C"), (F.col("o_custkey") + 1)).alias("claim_b")]
    kind = F.when(F.col("o_orderstatus") == "O", "contradiction").otherwise("contradiction_held")
    first = o.select(F.concat(F.lit("E"), "o_orderkey").alias("event_id"), (2 * F.col("o_orderkey").cast("long")).alias("seq"), kind.alias("type"), F.to_json(F.struct(*pair)).alias("payload"))
    ended = li.where("l_returnflag = 'R' OR l_linenumber = 7").select("l_orderkey").distinct().join(o.select(F.col("o_orderkey").alias("l_orderkey"), kind.alias("kind")), "l_orderkey")
    ident = F.concat(F.lit("E"), "l_orderkey")
    body = F.when(F.col("kind") == "contradiction", F.to_json(F.struct(ident.alias("contradiction_id")))).otherwise(F.to_json(F.struct(ident.alias("held_id"))))
    then = ended.select(F.concat(F.lit("R"), "l_orderkey").alias("event_id"), (2 * F.col("l_orderkey").cast("long") + 1).alias("seq"), F.when(F.col("kind") == "contradiction", "contradiction_resolved").otherwise("contradiction_dismissed").alias("type"), body.alias("payload"))
    rows = first.unionByName(then).select(F.lit("orders").alias("store"), "*", F.lit("2024-01-01T00:00:00Z").alias("t"))
    return rows.withColumn("p", F.from_json("payload", PAYLOAD))


_CONTRA = """ev AS (SELECT o_orderkey, o_orderstatus = 'O' AS said, 'C' || o_custkey AS claim_a, 'C' || (o_custkey + 1) AS claim_b, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_returnflag = 'R' OR l_linenumber = 7)) AS ended FROM orders)"""


@query(f"WITH {_CONTRA} SELECT 'E' || o_orderkey AS event_id, claim_a, claim_b FROM ev WHERE said AND NOT ended")
def open_contradictions(spark, sf):
    return contradict.open_contradictions(contradiction_log(spark, sf)).select("event_id", "claim_a", "claim_b")


@query(f"WITH {_CONTRA} SELECT 'E' || o_orderkey AS event_id, claim_a, claim_b FROM ev h WHERE NOT said AND NOT ended AND NOT EXISTS (SELECT 1 FROM ev d WHERE d.said AND d.claim_a = h.claim_a AND d.claim_b = h.claim_b)")
def held_contradictions(spark, sf):
    return contradict.held_contradictions(contradiction_log(spark, sf)).select("event_id", "claim_a", "claim_b")


_SAID = r"""said AS (SELECT DISTINCT 'X' || least(claim_a, claim_b) || greatest(claim_a, claim_b) AS event_id, least(claim_a, claim_b) AS claim_a, greatest(claim_a, claim_b) AS claim_b FROM claim_relations
    WHERE lower(regexp_replace(relation, '^\s+|\s+$', '', 'g')) = 'contradicts' AND claim_a <> claim_b)"""


@query(f"""WITH {_HIST}, {_SAID}, lv AS (SELECT claim_id, score, entrenchment AS e FROM hist WHERE to_us IS NULL),
    r AS (SELECT event_id, a.score AS sa, b.score AS sb, a.e AS ea, b.e AS eb, claim_a, claim_b FROM said LEFT JOIN lv a ON a.claim_id = claim_a LEFT JOIN lv b ON b.claim_id = claim_b),
    x AS (SELECT *, CASE WHEN sa IS NULL OR sb IS NULL THEN 'not-live' WHEN abs(ea - eb) < 1e-9 THEN 'tie' ELSE 'resolved' END AS outcome FROM r)
    SELECT event_id, outcome, CASE WHEN outcome = 'resolved' THEN CASE WHEN ea < eb THEN claim_a ELSE claim_b END END AS loser, CASE WHEN outcome = 'resolved' THEN
        round(CASE WHEN ea < eb THEN 0.1::DOUBLE * sb + sa * (1 - sb) ELSE 0.1::DOUBLE * sa + sb * (1 - sa) END, 6) END AS new FROM x""")
def contradictions_resolved(spark, sf):
    """Every contradiction that the consolidator found, declared and resolved."""
    r = table(spark, sf, "claim_relations").where(plain(F.col("relation")) == "contradicts").where("claim_a <> claim_b")
    pairs = r.select(F.least("claim_a", "claim_b").alias("claim_a"), F.greatest("claim_a", "claim_b").alias("claim_b")).distinct()
    lg = pairs.select(F.concat(F.lit("X"), "claim_a", "claim_b").alias("event_id"), F.lit("2024-01-01T00:00:00Z").alias("t"), F.lit("contradiction").alias("type"), F.from_json(F.to_json(F.struct("claim_a", "claim_b")), PAYLOAD).alias("p"))
    out, _ = revision.resolve(lg, history.live(hist(spark, sf)), edges(spark, sf), "2025-01-01T00:00:00Z")
    return out.select("event_id", "outcome", "loser", F.round("new", 6).alias("new"))


# ---- revision, impact ------------------------------------------------------------------------------------------------


def _root(spark: SparkSession, sf: str, score: float = 0.0) -> DataFrame:
    return spark.createDataFrame([(hub(spark, sf), score)], "root string, score double")


def owner_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A decision for each writer of critical claims, resting on these."""
    d = table(spark, sf, "claims").where("critical AND writer IS NOT NULL")
    return d.groupBy(F.concat(F.lit("D-"), "writer").alias("decision_id")).agg(F.collect_set("claim_id").alias("basis"))


@query(f"""WITH RECURSIVE {_REACH}, pc AS (SELECT id, distance, 1::HUGEINT AS k FROM near WHERE distance = 0
    UNION ALL SELECT n.id, n.distance, sum(p.k)::HUGEINT FROM pc p JOIN link l ON l.supports_id = p.id JOIN near n ON n.id = l.claim_id AND n.distance = p.distance + 1 GROUP BY n.id, n.distance),
    dd AS (SELECT DISTINCT 'D-' || writer AS decision_id, claim_id FROM claims WHERE critical AND writer IS NOT NULL),
    hit AS (SELECT decision_id, p.distance, p.k, min(p.distance) OVER (PARTITION BY decision_id) AS lo FROM dd JOIN pc p ON p.id = dd.claim_id),
    every AS (SELECT id, 'claim' AS kind, distance, k FROM pc WHERE distance > 0 UNION ALL SELECT decision_id, 'decision', distance + 1, sum(k)::HUGEINT FROM hit WHERE distance = lo GROUP BY 1, 2, 3),
    nearest AS (SELECT *, row_number() OVER (ORDER BY distance, id, kind) AS rn FROM every WHERE distance <= 6)
    SELECT id, kind, distance, least(k, 1000000000000000)::BIGINT AS path_count, least(k, 100)::INTEGER AS n_paths FROM nearest WHERE rn <= 1000""")
def impact_paths(spark, sf):
    """The answer as a user asks for it: up to 6 steps, the nearest 1,000 nodes, their shortest paths."""
    nodes, _ = revision.impact_report(edges(spark, sf), hub(spark, sf), owner_decisions(spark, sf), max_depth=6)
    return nodes.select("id", "kind", "distance", "path_count", F.size("paths").alias("n_paths"))


@query(f"""WITH RECURSIVE {revise_sql(0.0)} SELECT (SELECT id FROM root) AS root, (SELECT count(*) - 1 FROM ord) AS closure_size, (SELECT count(*) FROM moves) AS n_revisited,
    (SELECT count(*) FROM ord JOIN lv ON claim_id = id WHERE pos > 0) - (SELECT count(*) FROM moves) AS n_cutoff, (SELECT count(*) FROM moves WHERE flagged) AS n_flags""")
def revisit_report(spark, sf):
    """The figures of a pass in which the hub's score becomes 0."""
    _, s = revision.report(history.live(hist(spark, sf)), edges(spark, sf), _root(spark, sf))
    return s


@query(f"""WITH RECURSIVE {revise_sql(0.0)} SELECT DISTINCT 'D-' || writer AS decision_id FROM claims c WHERE critical AND writer IS NOT NULL AND (claim_id IN (SELECT claim_id FROM moves) OR claim_id = (SELECT id FROM root))""")
def decisions_affected(spark, sf):
    """Decisions that rest on what moves if the hub's score becomes 0."""
    moves, _ = revision.report(history.live(hist(spark, sf)), edges(spark, sf), _root(spark, sf))
    return revision.decisions_affected(moves, owner_decisions(spark, sf), _root(spark, sf)).select("decision_id")


@query(f"""WITH RECURSIVE {revise_sql(0.9)} SELECT 'assert' AS type, (SELECT id FROM root) AS claim_id, NULL AS new UNION ALL SELECT 'score_revision', claim_id, round(new, 6) FROM moves UNION ALL SELECT 'revisit', NULL, NULL""")
def evidence_ingested(spark, sf):
    """Events of a fact that takes the hub's place with credence 0.9: its assert, what it moves, the pass."""
    fact = _root(spark, sf, 0.9).select(F.col("root").alias("claim_id"), F.lit("observed").alias("statement"), F.col("score").alias("credence"))
    ev, _ = revision.ingest_evidence(history.live(hist(spark, sf)), edges(spark, sf), fact, "2025-01-01T00:00:00Z")
    p = F.from_json("payload", "claim_id string, new_score double")
    return ev.select("type", p["claim_id"].alias("claim_id"), F.round(p["new_score"], 6).alias("new"))


@query(f"WITH RECURSIVE {revise_sql(0.25)} SELECT claim_id, score AS old, 0.25::DOUBLE AS new, (SELECT count(*) FROM moves) AS revisited FROM lv WHERE claim_id = (SELECT id FROM root)")
def scores_by_hand(spark, sf):
    """The hub set to 0.25 by hand."""
    _, r = revision.manual_score(history.live(hist(spark, sf)), edges(spark, sf), _root(spark, sf, 0.25).withColumnRenamed("root", "claim_id"), "2025-01-01T00:00:00Z")
    return r


def trigger_quality(spark, sf):
    """Recall and precision of the cutoff for every critical live claim that others rest on, each challenged to 0."""
    live, e = history.live(hist(spark, sf)), edges(spark, sf)
    roots = live.where("critical").join(e.select(F.col("supports_id").alias("claim_id")).distinct(), "claim_id", "left_semi").select(F.col("claim_id").alias("root"), F.lit(0.0).alias("score"))
    return revision.quality(live, e, roots)


# ---- integrity -------------------------------------------------------------------------------------------------------



def _digit() -> Column:
    """Which claims of a projection are spoilt, and how: by the first hexadecimal digit of their MD5."""
    return F.substring(F.md5("claim_id"), 1, 1)


@query(f"""WITH {_VER}, m AS (SELECT store, CASE WHEN type = 'supersede' THEN j->>'old_claim_id' ELSE j->>'claim_id' END AS claim_id, seq, type FROM rec WHERE type IN ('assert', 'supersede', 'claim_status_changed')),
    st AS (SELECT store, claim_id, arg_max(type, seq) AS last, left(md5(claim_id), 1) AS d FROM m WHERE claim_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (type = 'assert') > 0),
    e AS (SELECT DISTINCT store, 'lost-' || (j->>'claim_id') AS claim_id FROM rec WHERE type = 'support' AND left(md5(j->>'claim_id'), 1) = '3')
    SELECT store, claim_id, CASE WHEN last <> 'assert' THEN 'ended-but-live' WHEN d = '0' THEN 'asserted-not-live' ELSE 'score-differs' END AS problem FROM st WHERE last <> 'assert' AND d = '2' OR last = 'assert' AND d IN ('0', '1')
    UNION ALL SELECT store, claim_id, 'no-assert: support_edges' FROM e""")
def store_faults(spark, sf):
    """A projection with rows dropped, scores moved, ended claims brought back and edges of unknown claims, checked against its log."""
    lg = log(spark, sf)
    v = fold.claim_versions(lg).select("store", "claim_id", "txn_to", "score").withColumn("d", _digit())
    ended = v.groupBy("store", "claim_id", "d").agg(F.count_if(F.col("txn_to").isNull()).alias("live")).where("live = 0 AND d = '2'").select("store", "claim_id", F.lit(None).cast("string").alias("txn_to"), F.lit(0.5).alias("score"))
    kept = v.where("NOT (txn_to IS NULL AND d = '0')").select("store", "claim_id", "txn_to", F.when(F.col("d") == "1", F.col("score") + 0.001).otherwise(F.col("score")).alias("score"))
    e = fold.support_edges(lg).select("store", F.when(_digit() == "3", F.concat(F.lit("lost-"), "claim_id")).otherwise(F.col("claim_id")).alias("claim_id"), "supports_id")
    known = lg.where("type = 'assert'").select("store", F.col("p.claim_id").alias("supports_id")).distinct()
    return audit.store_problems(lg, {"claims": kept.unionByName(ended), "support_edges": e.where("claim_id LIKE 'lost-%'").withColumn("supports_id", F.lit(None).cast("string")).unionByName(e.join(known, ["store", "supports_id"], "left_semi").where("claim_id NOT LIKE 'lost-%'").select("store", F.lit(None).cast("string").alias("claim_id"), "supports_id"))})


def faulty_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log with records missing, hashes changed and times changed."""
    lg = log(spark, sf).where("seq % 97 <> 5")
    return lg.withColumns({"hash": F.when(F.col("seq") % 89 == 3, F.repeat(F.lit("f"), 64)).otherwise(F.col("hash")), "t": F.when(F.col("seq") % 83 == 7, F.lit("2000-01-01T00:00:00Z")).otherwise(F.col("t"))})


_FAULTS = f"""{_HASHED}, spoilt AS (SELECT store, seq, prev_hash, CASE WHEN seq % 89 = 3 THEN repeat('f', 64) ELSE hash END AS hash, ok AND seq % 89 <> 3 AND seq % 83 <> 7 AS ok FROM hashed WHERE seq % 97 <> 5),
faults AS (SELECT s.store, s.seq, CASE WHEN s.seq > 1 AND p.hash IS NULL THEN 'BadSequence' WHEN s.prev_hash <> CASE WHEN s.seq = 1 THEN repeat('0', 64) ELSE p.hash END THEN 'BadPrevHash' WHEN NOT s.ok THEN 'BadHash' END AS problem
    FROM spoilt s LEFT JOIN spoilt p ON p.store = s.store AND p.seq = s.seq - 1)"""


@query(f"WITH {_FAULTS} SELECT store, seq, problem FROM faults WHERE problem IS NOT NULL")
def chain_faults(spark, sf):
    return chain.chain_problems(faulty_log(spark, sf))


@query(f"WITH {_FAULTS} SELECT store, min(seq) FILTER (problem IS NOT NULL) AS seq, arg_min(problem, seq) FILTER (problem IS NOT NULL) AS problem, count(*) AS checked FROM faults GROUP BY store")
def first_breaks(spark, sf):
    return audit.first_break(faulty_log(spark, sf))


@query(f"WITH {_FAULTS} SELECT store, min(seq) FILTER (problem IS NOT NULL) AS seq, arg_min(problem, seq) FILTER (problem IS NOT NULL) AS problem, count(*) AS checked FROM faults WHERE seq > 50 GROUP BY store")
def breaks_after_trusted(spark, sf):
    """Only what follows on record 50 of each store, whose hash is trusted."""
    lg = faulty_log(spark, sf)
    return audit.first_break(lg, lg.where("seq = 50").select("store", "seq", "hash"))


@query("""WITH r AS (SELECT store, seq, max(json_valid(payload)::INTEGER) AS good, max(CASE WHEN seq % 91 <> 4 THEN type END) AS type FROM (SELECT store, seq, type, CASE WHEN seq % 101 = 9 THEN '{torn' ELSE payload END AS payload FROM ledger_records) GROUP BY store, seq)
    SELECT store, seq, 'unparseable payload' AS problem FROM r WHERE good = 0 UNION ALL SELECT store, seq, 'missing type' FROM r WHERE type IS NULL
    UNION ALL SELECT store, seq, 'duplicate id ' || store || '/' || seq % 1000 FROM r WHERE seq % 1000 < 3 AND seq > 1000 AND EXISTS (SELECT 1 FROM r f WHERE f.store = r.store AND f.seq % 1000 = r.seq % 1000 AND f.seq < r.seq)""")
def record_faults(spark, sf):
    """Raw records with torn payloads, missing types and ids used twice."""
    r = table(spark, sf, "ledger_records")
    ident = F.when(F.col("seq") % 1000 < 3, F.concat("store", F.lit("/"), (F.col("seq") % 1000).cast("string"))).otherwise(F.concat("store", F.lit("#"), F.col("seq").cast("string")))
    r = r.withColumns({"payload": F.when(F.col("seq") % 101 == 9, "{torn").otherwise(F.col("payload")), "type": F.when(F.col("seq") % 91 != 4, F.col("type")), "id": ident})
    return audit.record_problems(r, "id")


@query(f"""WITH {_VER} SELECT r.store, count(*) AS events, (SELECT count(DISTINCT claim_id) FROM ver v WHERE v.store = r.store AND txn_to IS NULL) AS live_claims, max(seq) AS head_seq, arg_max(hash, seq) AS head_hash,
    max(seq) // 1024 AS checkpoints, count(*) FILTER (sig IS NULL) AS unsigned, 0::BIGINT AS problems, true AS ok FROM rec r GROUP BY r.store""")
def store_health(spark, sf):
    return audit.health(log(spark, sf))


@query(f"""WITH {_REC}, keyed AS (SELECT store, seq, 'unsigned' AS problem FROM rec WHERE sig IS NULL UNION ALL SELECT store, seq, 'unenrolled-key' FROM rec WHERE sig IS NOT NULL)
    SELECT store, problem, count(*) AS n FROM keyed GROUP BY store, problem""")
def governed_problems(spark, sf):
    """The stores held to the rules of governed ones: no record is signed by a key that a genesis key enrolled."""
    return audit.governed(log(spark, sf), "genesis", "00" * 32).groupBy("store", "problem").agg(F.count("*").alias("n"))


@query(f"WITH {_REC}, {_MERKLE}, last AS (SELECT store, max(no) AS no FROM lv10 GROUP BY store) SELECT store, kind, kind IN ('whole', 'same') AS consistent FROM last, (VALUES ('whole'), ('other-root'), ('same'), ('gap')) AS x(kind) WHERE no > 0 OR kind = 'same'")
def heads_consistent(spark, sf):
    """Pairs of heads of each store: first to last checkpoint, the same with another root, one head twice, and a wrong size."""
    cp = chain.checkpoints(log(spark, sf))
    head = cp.select("store", (F.col("no") + 1).alias("n"), F.col("last_seq").alias("size"), "root")
    ends = head.groupBy("store").agg(F.min(F.struct("n", "size", "root")).alias("a"), F.max(F.struct("n", "size", "root")).alias("b"))
    pair = lambda kind, a, b, size=None, root=None: ends.select("store", F.lit(kind).alias("kind"), F.col(f"{a}.n").alias("from_no"), (size if size is not None else F.col(f"{a}.size")).alias("from_size"), F.col(f"{a}.root").alias("from_root"), F.col(f"{b}.n").alias("to_no"), F.col(f"{b}.size").alias("to_size"), (root if root is not None else F.col(f"{b}.root")).alias("to_root"))
    pairs = pair("whole", "a", "b").unionByName(pair("other-root", "a", "b", root=F.repeat(F.lit("0"), 64))).unionByName(pair("gap", "a", "b", size=F.col("a.size") - 1)).where("from_no < to_no").unionByName(pair("same", "b", "b"))
    return audit.consistent_heads(pairs, cp).select("store", "kind", "consistent")


@query(f"WITH {_REC} SELECT store, seq, actor, type, hash FROM rec WHERE store = (SELECT min(store) FROM rec) AND seq = 5")
def record_by_seq(spark, sf):
    store = table(spark, sf, "ledger_records").agg(F.min("store")).first()[0]
    r = record_at(table(spark, sf, "ledger_records"), store, 5)
    return spark.createDataFrame([(r["store"], r["seq"], r["actor"], r["type"], r["hash"])], "store string, seq long, actor string, type string, hash string")


@query("SELECT s_suppkey, regexp_full_match(s, '[a-z0-9][a-z0-9-]{0,63}') AS ok FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN lower(replace(s_name, '#', '-')) WHEN s_suppkey % 3 = 1 THEN s_name ELSE '-' || s_suppkey END AS s FROM supplier)")
def tenant_slugs(spark, sf):
    s = F.when(F.col("s_suppkey") % 3 == 0, F.lower(F.replace("s_name", F.lit("#"), F.lit("-")))).when(F.col("s_suppkey") % 3 == 1, F.col("s_name")).otherwise(F.concat(F.lit("-"), "s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", audit.slug_ok(s).alias("ok"))


QUERIES["trigger_quality"] = trigger_quality
