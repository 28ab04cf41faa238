"""Queries over the ledger tables, one per operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefloom.functions import belief as B
from beliefloom.functions.text import plain
from beliefloom.operators import analytics as A
from beliefloom.operators import chain, contradict, fold, governance, graph, history, provenance, revision
from beliefloom.plans import lql
from beliefloom.plans.core_problems import _us, scored_outcomes, table
from beliefloom.sources.logs import clean_log

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Instants that the snapshot queries use: 2025-01-01 and 2025-07-01 UTC.
T1, T2 = 1_735_689_600_000_000, 1_751_328_000_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def bp(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 10000).cast("int")


def log(spark: SparkSession, sf: str) -> DataFrame:
    return clean_log(table(spark, sf, "ledger_records"))


def hist(spark: SparkSession, sf: str) -> DataFrame:
    return history.history(table(spark, sf, "claims"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return history.live_edges(table(spark, sf, "support_edges"))


_REC = """
rec AS (SELECT store, seq, min(t) AS t, min(actor) AS actor, min(type) AS type, min(payload)::JSON AS j, min(prev_hash) AS prev_hash, min(hash) AS hash, min(sig) AS sig
    FROM ledger_records WHERE json_valid(payload) GROUP BY store, seq)"""
_HIST = f"""
h0 AS (SELECT claim_id, {_us('txn_from')} AS from_us, {_us('txn_to')} AS end_us, statement, score, score_kind, status, materiality, critical, entrenchment, writer, source FROM claims),
h1 AS (SELECT claim_id, from_us, min(end_us) AS end_us, min(statement) AS statement, min(score) AS score, min(score_kind) AS score_kind, min(status) AS status, min(materiality) AS materiality,
    bool_and(critical) AS critical, min(entrenchment) AS entrenchment, min(writer) AS writer, min(source) AS source FROM h0 GROUP BY claim_id, from_us),
hist AS (SELECT *, least(end_us, lead(from_us) OVER (PARTITION BY claim_id ORDER BY from_us)) AS to_us, row_number() OVER (PARTITION BY claim_id ORDER BY from_us) AS seq FROM h1)"""
_E = r"""
e0 AS (SELECT lower(regexp_replace(claim_id, '^\s+|\s+$', '', 'g')) AS c0, lower(regexp_replace(supports_id, '^\s+|\s+$', '', 'g')) AS p0,
    lower(regexp_replace(kind, '^\s+|\s+$', '', 'g')) AS kind, p_given, p_given_not, strength, """ + _us("txn_from") + r""" AS from_us
    FROM support_edges WHERE txn_to IS NULL OR trim(txn_to) = ''),
edge AS (SELECT upper(c0[1]) || c0[2:] AS claim_id, upper(p0[1]) || p0[2:] AS supports_id, kind, min(from_us) AS from_us, arg_min(p_given, from_us) AS p_given,
    arg_min(p_given_not, from_us) AS p_given_not, arg_min(strength, from_us) AS strength FROM e0 WHERE c0 <> '' AND p0 <> '' GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3")


# ---- log, folds ------------------------------------------------------------------------------------------------------


@query(f"WITH {_REC} SELECT store, type, count(*) AS n FROM rec GROUP BY store, type")
def event_type_counts(spark, sf):
    return log(spark, sf).groupBy("store", "type").agg(F.count("*").alias("n"))


@query(f"WITH {_REC} SELECT store, seq, actor, type FROM rec WHERE type = 'score_revision' AND actor <> 'wire-ingest'")
def events_filtered(spark, sf):
    return log(spark, sf).where("type = 'score_revision' AND actor <> 'wire-ingest'").select("store", "seq", "actor", "type")


@query(f"WITH {_REC} SELECT store, seq FROM rec WHERE {_us('t')} >= {T1} AND {_us('t')} < {T2}")
def changed_between(spark, sf):
    return history.changed(log(spark, sf), T1, T2).select("store", "seq")


_VER = f"""{_REC},
ev AS (SELECT store, seq, type, t, CASE WHEN type = 'supersede' THEN j->>'old_claim_id' ELSE j->>'claim_id' END AS claim_id, j FROM rec
    WHERE type IN ('assert', 'score_revision', 'entrenchment_set', 'supersede', 'claim_status_changed')),
g AS (SELECT *, max(CASE WHEN type = 'assert' THEN seq END) OVER (PARTITION BY store, claim_id ORDER BY seq) AS opened FROM ev),
g2 AS (SELECT *, min(CASE WHEN type IN ('supersede', 'claim_status_changed') THEN seq END) OVER (PARTITION BY store, claim_id, opened) AS end_seq FROM g WHERE opened IS NOT NULL),
v AS (SELECT store, claim_id, seq, type, t, lead(t) OVER w AS txn_to,
    last_value(CASE WHEN type = 'assert' THEN (j->>'prior')::DOUBLE WHEN type = 'score_revision' THEN (j->>'new_score')::DOUBLE END IGNORE NULLS) OVER w AS score,
    last_value(CASE WHEN type = 'assert' THEN (j->>'entrenchment')::DOUBLE WHEN type = 'entrenchment_set' THEN (j->>'new')::DOUBLE END IGNORE NULLS) OVER w AS entrenchment,
    coalesce(lead(CASE WHEN type = 'supersede' THEN 'superseded' WHEN type = 'claim_status_changed' THEN j->>'status' END) OVER w, 'active') AS status
    FROM g2 WHERE end_seq IS NULL OR seq <= end_seq WINDOW w AS (PARTITION BY store, claim_id ORDER BY seq)),
ver AS (SELECT store, claim_id, seq, t, txn_to, score, entrenchment, status FROM v WHERE type NOT IN ('supersede', 'claim_status_changed'))"""


@query(f"WITH {_VER} SELECT store, claim_id, seq, t AS txn_from, txn_to, round(score * 10000)::INTEGER AS score_bp, round(entrenchment * 10000)::INTEGER AS ent_bp, status FROM ver")
def claim_versions(spark, sf):
    v = fold.claim_versions(log(spark, sf))
    return v.select("store", "claim_id", "seq", "txn_from", "txn_to", bp("score").alias("score_bp"), bp("entrenchment").alias("ent_bp"), "status")


@query(f"WITH {_VER} SELECT store, count(*) AS n_live, sum(round(score * 10000))::BIGINT AS sum_bp FROM ver WHERE txn_to IS NULL GROUP BY store")
def claims_live(spark, sf):
    v = history.live(fold.claim_versions(log(spark, sf)), "txn_to")
    return v.groupBy("store").agg(F.count("*").alias("n_live"), F.sum(bp("score")).cast("long").alias("sum_bp"))


@query(f"WITH {_VER} SELECT status, count(*) AS n FROM ver GROUP BY status")
def status_counts(spark, sf):
    return fold.claim_versions(log(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_REC} SELECT store, j->>'claim_id' AS claim_id, j->>'supports_id' AS supports_id, j->>'kind' AS kind, seq, round((j->>'p_given')::DOUBLE * 10000)::INTEGER AS p_bp
    FROM rec WHERE type = 'support'""")
def support_fold(spark, sf):
    e = fold.support_edges(log(spark, sf)).where("txn_to IS NULL")
    return e.select("store", "claim_id", "supports_id", "kind", "seq", bp("p_given").alias("p_bp"))


@query(f"WITH {_REC} SELECT store, j->>'claim_id' AS claim_id, count(*) AS n, sum(CASE WHEN j->>'outcome' = 'true' THEN 1 ELSE 0 END)::BIGINT AS n_true FROM rec WHERE type = 'outcome' GROUP BY 1, 2")
def outcomes_fold(spark, sf):
    return fold.outcomes(log(spark, sf)).groupBy("store", "claim_id").agg(F.count("*").alias("n"), F.sum("outcome").cast("long").alias("n_true"))


_DEC = f"""{_REC},
asserted AS (SELECT DISTINCT store, j->>'claim_id' AS claim_id FROM rec WHERE type = 'assert'),
d0 AS (SELECT store, seq, type, unnest(CASE WHEN type = 'decision' THEN (j->'basis')::VARCHAR[] ELSE [j->>'claim_id', j->>'old_claim_id', j->>'new_claim_id'] END) AS claim_id
    FROM rec WHERE type IN ('decision', 'supersede', 'claim_status_changed', 'contradiction_resolved')),
basis AS (SELECT DISTINCT store, seq, claim_id FROM d0 JOIN asserted USING (store, claim_id))"""


@query(f"""WITH {_DEC} SELECT r.store, r.seq, r.type AS kind, r.actor, count(b.claim_id) AS n_basis FROM rec r LEFT JOIN basis b ON b.store = r.store AND b.seq = r.seq
    WHERE r.type IN ('decision', 'supersede', 'claim_status_changed', 'contradiction_resolved') GROUP BY 1, 2, 3, 4""")
def decisions_index(spark, sf):
    d = fold.decisions(log(spark, sf))
    return d.select("store", "seq", "kind", "actor", F.size("basis").cast("long").alias("n_basis"))


@query(f"""WITH {_REC}, m AS (SELECT store, CASE WHEN type = 'supersede' THEN j->>'old_claim_id' ELSE j->>'claim_id' END AS claim_id, seq, type, j FROM rec
    WHERE type IN ('assert', 'score_revision', 'supersede', 'claim_status_changed'))
    SELECT store, claim_id, min(seq) FILTER (type = 'assert') AS assert_seq,
    round(arg_max(coalesce(j->>'prior', j->>'new_score')::DOUBLE, seq) FILTER (type IN ('assert', 'score_revision')) * 10000)::INTEGER AS score_bp,
    arg_max(CASE WHEN type = 'assert' THEN 'active' WHEN type = 'supersede' THEN 'superseded' ELSE j->>'status' END, seq) FILTER (type <> 'score_revision') AS status,
    arg_max(j->>'new_claim_id', seq) FILTER (type = 'supersede') AS superseded_by
    FROM m GROUP BY store, claim_id HAVING count(*) FILTER (type = 'assert') > 0""")
def matrix_rows(spark, sf):
    m = fold.matrix(log(spark, sf))
    return m.select("store", "claim_id", "assert_seq", bp("confidence").alias("score_bp"), "status", "superseded_by")


@query(f"""WITH {_REC}, m AS (SELECT store, seq, unnest([j->>'claim_id', j->>'old_claim_id', j->>'new_claim_id', j->>'supports_id'] || CASE WHEN type = 'decision' THEN (j->'basis')::VARCHAR[] ELSE [] END) AS claim_id FROM rec)
    SELECT store, claim_id, count(DISTINCT seq) AS n_events, min(seq) AS first_seq, max(seq) AS last_seq FROM m WHERE claim_id IS NOT NULL GROUP BY store, claim_id""")
def map_evidence(spark, sf):
    return fold.evidence(log(spark, sf)).groupBy("store", "claim_id").agg(F.count("*").alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("""SELECT user_id, event_id, event_type, epoch_us(ts) AS from_us, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) AS to_us FROM events""")
def scd2_user_state(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return fold.scd2(e, ["user_id"], "event_id", "us", ["event_type"]).select("user_id", "event_id", "event_type", F.col("txn_from").alias("from_us"), F.col("txn_to").alias("to_us"))


# ---- claim tables ----------------------------------------------------------------------------------------------------


@query(f"WITH {_HIST} SELECT claim_id, seq, from_us, to_us, round(score * 10000)::INTEGER AS score_bp FROM hist")
def claim_history(spark, sf):
    return hist(spark, sf).select("claim_id", F.col("seq").cast("long").alias("seq"), "from_us", "to_us", bp("score").alias("score_bp"))


@query(f"WITH {_HIST} SELECT claim_id, from_us, round(score * 10000)::INTEGER AS score_bp FROM hist WHERE from_us <= {T1} AND (to_us IS NULL OR to_us > {T1})")
def believed_at(spark, sf):
    return history.believed_at(hist(spark, sf), T1).select("claim_id", "from_us", bp("score").alias("score_bp"))


@query(f"WITH {_HIST} SELECT claim_id, seq FROM hist WHERE to_us IS NULL AND coalesce(score > 0.45, false) AND coalesce(status = 'active', false)")
def claims_filtered(spark, sf):
    return lql.execute(ledger(spark, sf), lql.parse("CLAIMS WHERE score > 0.45 AND status = 'active'")).select("claim_id", F.col("seq").cast("long").alias("seq"))


def ledger(spark: SparkSession, sf: str) -> lql.Ledger:
    def decisions() -> DataFrame:
        lg = log(spark, sf)
        d = fold.decisions(lg).withColumn("decision_id", F.concat("store", F.lit("/"), F.col("seq").cast("string")))
        return d.join(lg.select("store", "seq", "t_us"), ["store", "seq"])

    links = lambda: edges(spark, sf).select("claim_id", "supports_id", "kind", "p_given", "p_given_not", "strength", "from_us")
    return lql.Ledger(lambda: hist(spark, sf), links, lambda: log(spark, sf), decisions, lambda: tiers(spark, sf))


def tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Live tiers of writers: an owner has written critical claims, a contributor at least 20 versions."""
    c = table(spark, sf, "claims").where("writer IS NOT NULL").groupBy("writer").agg(F.max(F.col("critical").cast("int")).alias("crit"), F.count("*").alias("n"))
    return c.select("writer", F.when(F.col("crit") == 1, "owner").when(F.col("n") >= 20, "contributor").otherwise("provisional").alias("tier"))


_TIERS = """tiers AS (SELECT writer, CASE WHEN max(critical::INTEGER) = 1 THEN 'owner' WHEN count(*) >= 20 THEN 'contributor' ELSE 'provisional' END AS tier
    FROM claims WHERE writer IS NOT NULL GROUP BY writer)"""


@query(f"""WITH {_HIST}, {_TIERS} SELECT claim_id, seq FROM hist LEFT JOIN tiers USING (writer) WHERE to_us IS NULL
    AND (coalesce(tier <> 'owner', true) AND coalesce(score >= 0.8, false) OR coalesce(critical = true, false))""")
def lql_or_and(spark, sf):
    return ledger(spark, sf).query("CLAIMS WHERE tier != 'owner' AND score >= 0.8 OR critical = true").select("claim_id", F.col("seq").cast("long").alias("seq"))


@query(f"WITH {_HIST} SELECT claim_id, seq FROM hist WHERE from_us <= {T1} AND (to_us IS NULL OR to_us > {T1}) AND coalesce(score < 0.3, false)")
def lql_asof_claims(spark, sf):
    return ledger(spark, sf).query("AS_OF 2025-01-01T00:00:00Z CLAIMS WHERE score < 0.3").select("claim_id", F.col("seq").cast("long").alias("seq"))


@query(f"WITH {_HIST}, top AS (SELECT max(claim_id) AS c FROM claims) SELECT claim_id, seq, round(score * 10000)::INTEGER AS score_bp FROM hist WHERE to_us IS NULL AND claim_id = (SELECT c FROM top)")
def lql_claim(spark, sf):
    c = table(spark, sf, "claims").agg(F.max("claim_id")).first()[0]
    return ledger(spark, sf).query(f"CLAIM '{c}'").select("claim_id", F.col("seq").cast("long").alias("seq"), bp("score").alias("score_bp"))


@query(f"WITH {_REC} SELECT store, seq FROM rec WHERE {_us('t')} <= {T1} AND type = 'outcome'")
def lql_asof_events(spark, sf):
    return ledger(spark, sf).query("AS_OF 2025-01-01T00:00:00Z EVENTS WHERE type = 'outcome'").select("store", "seq")


@query(f"WITH {_REC} SELECT store, seq FROM rec WHERE type = 'claim_status_changed' AND actor <> 'human-c'")
def lql_decisions(spark, sf):
    return ledger(spark, sf).query("DECISIONS WHERE kind = 'claim_status_changed' AND actor != 'human-c'").select("store", "seq")


_part = lambda x: f"unhex(printf('%08x', octet_length(encode({x})))) || encode({x})"
_HASHED = f"""{_REC},
kv AS (SELECT store, seq, j, unnest(list_sort(json_keys(j))) AS k FROM rec),
canon AS (SELECT store, seq, '{{' || string_agg(to_json(k)::VARCHAR || ':' || CASE WHEN json_type(j->k) = 'VARCHAR' THEN to_json(j->>k)::VARCHAR ELSE (j->k)::VARCHAR END, ',' ORDER BY k) || '}}' AS body FROM kv GROUP BY store, seq),
hashed AS (SELECT r.*, sha256('ELCHAIN1'::BLOB || {' || '.join(map(_part, ('r.seq::VARCHAR', 't', 'actor', 'type', 'body', 'prev_hash')))}) = hash AS ok FROM rec r JOIN canon c ON c.store = r.store AND c.seq = r.seq)"""


@query(f"""WITH {_HASHED}, {_HIST}, bad AS (SELECT count(*) AS n FROM hashed r LEFT JOIN hashed p ON p.store = r.store AND p.seq = r.seq - 1 WHERE NOT r.ok OR r.prev_hash IS DISTINCT FROM CASE WHEN r.seq = 1 THEN repeat('0', 64) ELSE p.hash END)
    SELECT (SELECT count(*) FROM rec) AS events, (SELECT count(*) FROM hist WHERE to_us IS NULL) AS live_claims, n AS problems, n = 0 AS ok FROM bad""")
def lql_health(spark, sf):
    return ledger(spark, sf).query("HEALTH")


_ROOT = "(SELECT supports_id FROM edge GROUP BY supports_id ORDER BY count(DISTINCT claim_id) DESC, supports_id LIMIT 1)"


def hub(spark: SparkSession, sf: str) -> str:
    """The supporter of most claims."""
    n = edges(spark, sf).groupBy("supports_id").agg(F.countDistinct("claim_id").alias("n")).orderBy(F.desc("n"), "supports_id")
    return n.first()[0]


_REACH = f"""{_E}, link AS (SELECT DISTINCT claim_id, supports_id FROM edge),
w AS (SELECT {_ROOT} AS id, 0 AS d UNION SELECT l.claim_id, w.d + 1 FROM w JOIN link l ON l.supports_id = w.id WHERE w.d < 500),
near AS (SELECT id, min(d) AS distance FROM w GROUP BY id)"""


@query(f"WITH RECURSIVE {_REACH} SELECT id AS claim_id, distance FROM near WHERE distance > 0")
def lql_depends(spark, sf):
    return ledger(spark, sf).query(f"DEPENDS '{hub(spark, sf)}'")


@query(f"""WITH RECURSIVE {_REACH}, pc AS (SELECT id, distance, 1::HUGEINT AS k FROM near WHERE distance = 0
    UNION ALL SELECT n.id, n.distance, sum(p.k)::HUGEINT FROM pc p JOIN link l ON l.supports_id = p.id JOIN near n ON n.id = l.claim_id AND n.distance = p.distance + 1 GROUP BY n.id, n.distance)
    SELECT id AS claim_id, distance, least(k, 1000000000000000)::BIGINT AS path_count FROM pc WHERE distance > 0""")
def path_count(spark, sf):
    root = spark.createDataFrame([(hub(spark, sf),)], "root string")
    r = graph.reach(edges(spark, sf), "supports_id", "claim_id", root)
    return r.select(F.col("node").alias("claim_id"), "distance", "path_count")


@query(f"""WITH {_E}, {_HIST} SELECT e.claim_id, e.supports_id, e.kind, round(h.score * 10000)::INTEGER AS supporter_bp FROM edge e LEFT JOIN hist h ON h.claim_id = e.supports_id AND h.to_us IS NULL""")
def why(spark, sf):
    return history.why(edges(spark, sf), hist(spark, sf)).select("claim_id", "supports_id", "kind", bp("supporter_score").alias("supporter_bp"))


@query(f"WITH {_HIST}, {_TIERS} SELECT h.claim_id, h.writer, t.tier FROM hist h LEFT JOIN tiers t USING (writer) WHERE h.to_us IS NULL")
def writer_tiers(spark, sf):
    return history.live(hist(spark, sf)).join(tiers(spark, sf), "writer", "left").select("claim_id", "writer", "tier")


_FIELDS = ["claim_id", "statement", "valid_from", "valid_to", "score", "status", "writer", "source", "falsifier", "does_not_establish"]


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS n FROM claims" for f in _FIELDS))
def coverage_counts(spark, sf):
    return A.coverage(table(spark, sf, "claims"), _FIELDS)


_SP = r"regexp_replace(statement, '\s+', ' ', 'g')"


@query(f"SELECT sha256(trim({_SP})) AS fingerprint, count(*) AS n FROM (SELECT DISTINCT claim_id, statement FROM claims WHERE statement IS NOT NULL) GROUP BY 1")
def fingerprint_census(spark, sf):
    return A.fingerprint_census(table(spark, sf, "claims").where("statement IS NOT NULL").select("claim_id", "statement").distinct())


@query(f"SELECT sha256(trim({_SP})) AS fingerprint, count(*) AS n FROM (SELECT DISTINCT claim_id, statement FROM claims WHERE statement IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return fingerprint_census(spark, sf).where("n > 1")


# ---- calibration, churn ----------------------------------------------------------------------------------------------

_CASES = f"""
pv AS (SELECT claim_id, from_us, min(to_us) AS to_us, min(score) AS score FROM (SELECT claim_id, {_us('txn_from')} AS from_us, {_us('txn_to')} AS to_us, score FROM claims) GROUP BY claim_id, from_us),
cases AS (SELECT o.claim_id, o.outcome, v.score FROM (SELECT claim_id, {_us('t')} AS t_us, outcome FROM outcomes) o ASOF JOIN pv v ON o.claim_id = v.claim_id AND o.t_us >= v.from_us
    WHERE v.to_us IS NULL OR v.to_us > o.t_us)"""


@query(f"WITH {_CASES} SELECT count(*) AS n, sum((round(score * 10000)::BIGINT - outcome * 10000) ** 2)::BIGINT AS sum_sq FROM cases")
def brier_global(spark, sf):
    c = scored_outcomes(spark, sf).select(bp("score").cast("long").alias("s"), (F.col("outcome") * 10000).cast("long").alias("o"))
    return c.agg(F.count("*").alias("n"), F.sum((F.col("s") - F.col("o")) * (F.col("s") - F.col("o"))).alias("sum_sq"))


@query(f"WITH {_CASES} SELECT claim_id, count(*) AS n, floor(avg((score - outcome) ** 2) * 1000000 + 0.1234567)::BIGINT AS brier_ppm FROM cases GROUP BY claim_id HAVING count(*) >= 3")
def brier_per_claim(spark, sf):
    c = scored_outcomes(spark, sf).groupBy("claim_id").agg(F.count("*").alias("n"), F.floor(F.avg(F.pow(F.col("score") - F.col("outcome"), 2)) * 1000000 + 0.1234567).alias("brier_ppm"))
    return c.where("n >= 3")


_LEARN = f"""{_HIST}, {_CASES},
per AS (SELECT claim_id, count(*) AS n, greatest(0, least(1, 1 - avg((score - outcome) ** 2))) AS new FROM cases GROUP BY claim_id HAVING count(*) >= 3),
learned AS (SELECT p.claim_id, h.entrenchment AS old, p.new, p.n FROM per p JOIN hist h ON h.claim_id = p.claim_id AND h.to_us IS NULL WHERE abs(p.new - h.entrenchment) >= 1e-9)"""


@query(f"WITH {_LEARN} SELECT claim_id, n, round(old, 4) AS old, round(new, 4) AS new FROM learned")
def learned_entrenchment(spark, sf):
    out = A.learned_entrenchment(scored_outcomes(spark, sf), history.live(hist(spark, sf)))
    return out.select("claim_id", "n", F.round("old", 4).alias("old"), F.round("new", 4).alias("new"))


@query(f"""WITH {_LEARN}, f AS (SELECT claim_id, (score > 0.5) <> lag(score > 0.5) OVER (PARTITION BY claim_id ORDER BY from_us) AS flip FROM hist),
    s AS (SELECT claim_id, count(*) AS versions, coalesce(sum(flip::INTEGER), 0)::BIGINT AS flips FROM f GROUP BY claim_id HAVING count(*) >= 5)
    SELECT s.claim_id, s.versions, s.flips, round(h.entrenchment * (1 - least(0.5, s.flips / s.versions)), 4) AS new FROM s JOIN hist h ON h.claim_id = s.claim_id AND h.to_us IS NULL
    WHERE s.claim_id NOT IN (SELECT claim_id FROM learned) AND h.entrenchment * least(0.5, s.flips / s.versions) >= 1e-9""")
def stability_decay(spark, sf):
    h = hist(spark, sf)
    learned = A.learned_entrenchment(scored_outcomes(spark, sf), history.live(h))
    return A.stability_decay(h, history.live(h), learned).select("claim_id", "versions", "flips", F.round("new", 4).alias("new"))


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    r = log(spark, sf).where("type = 'score_revision'")
    return r.select("store", F.col("p.claim_id").alias("claim_id"), "seq", F.col("p.old_score").alias("old_score"), F.col("p.new_score").alias("new_score"))


_REV = f"""{_REC}, rv AS (SELECT store, j->>'claim_id' AS claim_id, seq, (j->>'old_score')::DOUBLE AS o, (j->>'new_score')::DOUBLE AS n,
    row_number() OVER (PARTITION BY store, j->>'claim_id' ORDER BY seq DESC) AS rk FROM rec WHERE type = 'score_revision'),
last AS (SELECT * FROM rv WHERE rk <= 10),
mv AS (SELECT *, n - o AS d FROM last WHERE abs(n - o) > 1e-9),
sg AS (SELECT store, claim_id, d, sign(d) <> lag(sign(d)) OVER (PARTITION BY store, claim_id ORDER BY seq) AS turn FROM mv)"""


def materiality(lg: DataFrame) -> DataFrame:
    """store, claim_id, materiality of the claims that are live at the end."""
    key = F.when(F.col("type") == "supersede", F.col("p.old_claim_id")).otherwise(F.col("p.claim_id"))
    e = lg.where(F.col("type").isin("assert", "supersede", "claim_status_changed")).groupBy("store", key.alias("claim_id"))
    e = e.agg(F.max_by("type", "seq").alias("last"), F.max_by("p.materiality", F.when(F.col("type") == "assert", F.col("seq"))).alias("materiality"))
    return e.where("last = 'assert' AND materiality IS NOT NULL").select("store", "claim_id", "materiality")


def churned(spark: SparkSession, sf: str) -> DataFrame:
    h = A.last_revisions(revisions(spark, sf), ["store", "claim_id"]).join(materiality(log(spark, sf)), ["store", "claim_id"], "left")
    return A.churn(h.withColumn("materiality", F.coalesce("materiality", F.lit(0.05))), F.col("materiality"))


@query(f"""WITH {_REV} SELECT k.store, k.claim_id, coalesce(sum(turn::INTEGER), 0)::INTEGER AS raw FROM (SELECT DISTINCT store, claim_id FROM last) k LEFT JOIN sg USING (store, claim_id) GROUP BY 1, 2""")
def churn_raw(spark, sf):
    return churned(spark, sf).select("store", "claim_id", "raw")


@query(f"""WITH {_REV}, t AS (SELECT store, claim_id, sum(CASE WHEN d > 0 THEN d ELSE 0 END) AS up, sum(CASE WHEN d < 0 THEN -d ELSE 0 END) AS down FROM sg GROUP BY 1, 2)
    SELECT store, claim_id, round(up + down, 6) AS gross_travel, round(2 * least(up, down) / (up + down), 6) AS conflict_balance FROM t""")
def churn_travel(spark, sf):
    return churned(spark, sf).where("gross_travel > 0").select("store", "claim_id", F.round("gross_travel", 6).alias("gross_travel"), F.round("conflict_balance", 6).alias("conflict_balance"))


_WALK = f"""{_REV},
    ms AS (SELECT store, CASE WHEN type = 'supersede' THEN j->>'old_claim_id' ELSE j->>'claim_id' END AS claim_id, arg_max(type, seq) AS last, arg_max((j->>'materiality')::DOUBLE, seq) FILTER (type = 'assert') AS mat
        FROM rec WHERE type IN ('assert', 'supersede', 'claim_status_changed') GROUP BY 1, 2),
    o AS (SELECT l.store, l.claim_id, n, o, coalesce(ms.mat, 0.05) AS m, row_number() OVER (PARTITION BY l.store, l.claim_id ORDER BY seq) AS k FROM last l
        LEFT JOIN ms ON ms.store = l.store AND ms.claim_id = l.claim_id AND ms.last = 'assert'),
    wk AS (SELECT store, claim_id, 0 AS k, o AS a, 0 AS dir, 0 AS moves, 0 AS turns FROM o WHERE k = 1
    UNION ALL SELECT w.store, w.claim_id, w.k + 1, CASE WHEN abs(o.n - w.a) >= o.m THEN o.n ELSE w.a END,
        CASE WHEN abs(o.n - w.a) >= o.m THEN CASE WHEN o.n > w.a THEN 1 ELSE -1 END ELSE w.dir END, w.moves + (abs(o.n - w.a) >= o.m)::INTEGER,
        w.turns + (abs(o.n - w.a) >= o.m AND w.dir <> 0 AND w.dir <> CASE WHEN o.n > w.a THEN 1 ELSE -1 END)::INTEGER
        FROM wk w JOIN o ON o.store = w.store AND o.claim_id = w.claim_id AND o.k = w.k + 1),
    walked AS (SELECT store, claim_id, arg_max(moves, k) AS material_moves, arg_max(turns, k) AS material_churn FROM wk GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_WALK} SELECT store, claim_id, material_moves, material_churn FROM walked")
def churn_material(spark, sf):
    return churned(spark, sf).select("store", "claim_id", "material_moves", "material_churn")


@query(f"""WITH {_REC} SELECT count(*) AS n, coalesce(sum((actor = 'human' AND j->>'triggering_event_id' IS NULL)::INTEGER), 0)::BIGINT AS manual FROM rec WHERE type = 'score_revision'""")
def override_rate(spark, sf):
    return A.override_rate(log(spark, sf)).select("n", F.col("manual").cast("long").alias("manual"))


_FAN = f"""{_E}, link AS (SELECT DISTINCT claim_id, supports_id FROM edge),
anc AS (SELECT claim_id, supports_id AS a FROM link UNION SELECT n.claim_id, l.supports_id FROM anc n JOIN link l ON l.claim_id = n.a)"""


@query(f"WITH RECURSIVE {_FAN} SELECT claim_id, count(*) AS n_support FROM anc GROUP BY claim_id")
def fanout(spark, sf):
    """Claims that each claim rests on, over live edges of every kind."""
    return graph.reached(edges(spark, sf), "claim_id", "supports_id").withColumnRenamed("n", "n_support")


@query(f"""WITH RECURSIVE {_FAN}, {_HIST}, f AS (SELECT claim_id, count(*) AS n FROM anc GROUP BY claim_id), lv AS (SELECT claim_id FROM hist WHERE to_us IS NULL)
    SELECT count(*) AS n_claims, round(avg(coalesce(n, 0)), 6) AS avg_fanout, max(coalesce(n, 0)) AS max_fanout FROM lv LEFT JOIN f USING (claim_id)""")
def fanout_summary(spark, sf):
    """Over all live claims, those that rest on nothing included."""
    n = history.live(hist(spark, sf)).select("claim_id").join(fanout(spark, sf), "claim_id", "left").select(F.coalesce("n_support", F.lit(0)).alias("n"))
    return n.agg(F.count("*").alias("n_claims"), F.round(F.avg("n"), 6).alias("avg_fanout"), F.max("n").alias("max_fanout"))


def kill_values(spark: SparkSession, sf: str) -> DataFrame:
    """One row of the metrics that bars exist for, and counts behind them."""
    lg = log(spark, sf)
    parts = [
        A.trigger_log(lg), fanout_summary(spark, sf).select("max_fanout", "avg_fanout", "n_claims"), A.brier(scored_outcomes(spark, sf)).select("brier"),
        A.override_rate(lg).select(F.col("rate").alias("override_rate"), F.col("n").alias("n_score_revisions"), F.col("manual").alias("n_manual_overrides")),
        churned(spark, sf).agg(F.coalesce(F.max("material_churn"), F.lit(0)).alias("max_material_churn"), F.coalesce(F.max("raw"), F.lit(0)).alias("max_churn")),
        contradict.open_contradictions(lg.withColumn("event_id", F.concat("store", F.lit("/"), F.col("seq").cast("string")))).agg(F.count("*").alias("n_open_contradictions")),
    ]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))


_KILL = f"""{_FAN}, {_HIST}, {_CASES}, {_WALK}, f AS (SELECT claim_id, count(*) AS n FROM anc GROUP BY claim_id), lv AS (SELECT claim_id FROM hist WHERE to_us IS NULL),
    fl AS (SELECT coalesce((j->>'n_flags')::INTEGER, 0) AS k FROM rec WHERE type = 'revisit'),
    v AS (SELECT (SELECT max(coalesce(n, 0)) FROM lv LEFT JOIN f USING (claim_id))::DOUBLE AS max_fanout, (SELECT avg((score - outcome) ** 2) FROM cases) AS brier,
        (SELECT avg((actor = 'human' AND j->>'triggering_event_id' IS NULL)::INTEGER) FROM rec WHERE type = 'score_revision') AS override_rate,
        (SELECT coalesce(max(material_churn), 0) FROM walked)::DOUBLE AS max_material_churn, (SELECT coalesce(avg(k), 0) FROM fl)::DOUBLE AS mean_flags, (SELECT coalesce(max(k), 0) FROM fl)::DOUBLE AS max_flags,
        (SELECT count(*) FROM rec WHERE type = 'contradiction')::DOUBLE AS n_open_contradictions)"""


@query(f"WITH RECURSIVE {_KILL} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS criterion, round({c}, 6) AS value, {c} > {bar} AS breached FROM v" for c, bar in A.BARS.items() if c not in A.BELOW) + ") WHERE value IS NOT NULL")
def kill_bars(spark, sf):
    """Every bar that a log has a value for; trigger recall and precision come from an audit (trigger_quality)."""
    return A.kill_bars(kill_values(spark, sf)).select("criterion", F.round("value", 6).alias("value"), "breached")


@query(f"""WITH RECURSIVE {_KILL} SELECT round(mean_flags, 6) AS mean_flags, max_flags::BIGINT AS max_flags, (SELECT count(*) FROM fl) AS n_revisits, max_fanout::BIGINT AS max_fanout, (SELECT count(*) FROM lv) AS n_claims,
    round(brier, 6) AS brier, round(override_rate, 6) AS override_rate, (SELECT count(*) FROM rec WHERE type = 'score_revision') AS n_score_revisions, max_material_churn::BIGINT AS max_material_churn,
    n_open_contradictions::BIGINT AS n_open_contradictions FROM v""")
def kill_metrics(spark, sf):
    v = kill_values(spark, sf)
    whole = [F.col(c).cast("long").alias(c) for c in ("max_flags", "n_revisits", "max_fanout", "n_claims", "n_score_revisions", "max_material_churn", "n_open_contradictions")]
    return v.select(*whole, *(F.round(c, 6).alias(c) for c in ("mean_flags", "brier", "override_rate")))


# ---- graph, contradictions -------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_REACH}, dd AS (SELECT DISTINCT 'D-' || writer AS decision_id, claim_id FROM claims WHERE critical AND writer IS NOT NULL),
    dn AS (SELECT decision_id, min(n.distance) + 1 AS distance FROM dd JOIN near n ON n.id = dd.claim_id GROUP BY decision_id)
    SELECT 'claim' AS kind, id, distance FROM near WHERE distance > 0 UNION ALL SELECT 'decision', decision_id, distance FROM dn""")
def impact_nodes(spark, sf):
    """What rests on the hub: claims, and decisions (here one per writer, resting on the critical claims it wrote)."""
    root = spark.createDataFrame([(hub(spark, sf),)], "root string")
    d = table(spark, sf, "claims").where("critical AND writer IS NOT NULL").select(F.concat(F.lit("D-"), "writer").alias("decision_id"), F.array("claim_id").alias("basis"))
    return graph.impact(edges(spark, sf), root, d).select("kind", "id", "distance")


def revise_sql(target: float, root: str = _ROOT) -> str:
    """The walk of a revision in SQL: visits in breadth-first order (ord), then one claim after another (st), the last supporter that moved deciding."""
    return f"""{_E}, {_HIST}, root AS MATERIALIZED (SELECT {root} AS id), lv AS MATERIALIZED (SELECT claim_id, score, materiality, critical FROM hist WHERE to_us IS NULL),
    eo AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY from_us, claim_id, supports_id, p_given, p_given_not, strength) AS en FROM edge),
    reach AS (SELECT id FROM root UNION SELECT e.claim_id FROM reach r JOIN eo e ON e.supports_id = r.id), re AS MATERIALIZED (SELECT e.* FROM eo e SEMI JOIN reach r ON e.supports_id = r.id),
    visit(id, pos) USING KEY (id) AS (SELECT id, 0::BIGINT FROM root UNION SELECT claim_id, (SELECT max(pos) FROM recurring.visit) + row_number() OVER (ORDER BY ppos, en) FROM (
        SELECT e.claim_id, min(w.pos) AS ppos, arg_min(e.en, (w.pos, e.en)) AS en FROM visit w JOIN re e ON e.supports_id = w.id WHERE NOT EXISTS (SELECT 1 FROM recurring.visit k WHERE k.id = e.claim_id) GROUP BY e.claim_id)),
    ord AS MATERIALIZED (SELECT id, pos FROM visit),
    st(id, pos, old, new, moved) USING KEY (id) AS (SELECT id, 0::BIGINT, NULL::DOUBLE, {target}::DOUBLE, true FROM root
        UNION SELECT o.id, o.pos, l.score, CASE WHEN abs(h.new - l.score) >= 0.005 THEN h.new ELSE l.score END, coalesce(abs(h.new - l.score) >= 0.005, false)
        FROM (SELECT max(pos) + 1 AS p FROM st) n JOIN ord o ON o.pos = n.p LEFT JOIN lv l ON l.claim_id = o.id
        LEFT JOIN (SELECT e.claim_id, arg_max(e.p_given * s.new + e.p_given_not * (1 - s.new), e.en) AS new FROM re e JOIN recurring.st s ON s.id = e.supports_id AND s.moved GROUP BY e.claim_id) h ON h.claim_id = o.id),
    moves AS (SELECT st.id AS claim_id, st.pos, st.old, st.new, abs(st.new - st.old) >= l.materiality OR l.critical AS flagged FROM st JOIN lv l ON l.claim_id = st.id WHERE moved AND pos > 0)"""


@query(f"WITH RECURSIVE {revise_sql(0.0)} SELECT claim_id, round(old, 6) AS old, round(new, 6) AS new, flagged FROM moves")
def revisit_moves(spark, sf):
    """What would move if the hub's score became 0: claims in the order visited, with flags."""
    root = spark.createDataFrame([(hub(spark, sf), 0.0)], "root string, score double")
    out = graph.revisit(history.live(hist(spark, sf)), revision.by_attachment(edges(spark, sf)), root)
    return out.select("claim_id", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), "flagged")


_LIVE_ROOT = "(SELECT supports_id FROM edge SEMI JOIN (SELECT claim_id FROM hist WHERE to_us IS NULL) v ON v.claim_id = supports_id GROUP BY supports_id ORDER BY count(DISTINCT claim_id) DESC, supports_id LIMIT 1)"


@query(f"WITH RECURSIVE {revise_sql(0.1, _LIVE_ROOT)} SELECT claim_id, round(old, 6) AS old, round(new, 6) AS new FROM moves")
def lql_propagated(spark, sf):
    """The same through the query language, for the live supporter of most claims."""
    live = history.live(hist(spark, sf)).select(F.col("claim_id").alias("supports_id"))
    n = edges(spark, sf).join(live, "supports_id", "left_semi").groupBy("supports_id").agg(F.countDistinct("claim_id").alias("n")).orderBy(F.desc("n"), "supports_id")
    out = ledger(spark, sf).query(f"IMPACT '{n.first()[0]}' PROPAGATED TO 0.1")
    return out.select("claim_id", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"))

@query("""WITH s AS (SELECT c.c_custkey, n.n_nationkey, r.r_regionkey, 0.1 + 0.2 * r.r_regionkey AS sr FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)
    SELECT c_custkey, round(0.95::DOUBLE * (0.9::DOUBLE * sr + 0.2::DOUBLE * (1 - sr)) + 0.3::DOUBLE * (1 - (0.9::DOUBLE * sr + 0.2::DOUBLE * (1 - sr))), 9) AS score FROM s""")
def jeffrey_columns(spark, sf):
    c, n, r = (table(spark, sf, x) for x in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    top = F.lit(0.1) + F.lit(0.2) * F.col("r_regionkey")
    mid = B.jeffrey(F.lit(0.9), F.lit(0.2), top)
    return j.select("c_custkey", F.round(B.jeffrey(F.lit(0.95), F.lit(0.3), mid), 9).alias("score"))


# The offset keeps products of short decimals, which are exact multiples, away from the edge of a unit.
def _parents(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", (F.col("l_quantity") / 50).alias("s"), (F.lit(1.0) - F.col("l_discount")).alias("w")).alias("x"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select("l_orderkey", F.transform("x", lambda v: v["s"]).alias("s"), F.transform("x", lambda v: v["w"]).alias("w"))


@query("SELECT l_orderkey, floor((0.05 + 0.95 * product((1 - l_discount) * l_quantity / 50 + l_discount)) * 1000000 + 0.1234567)::BIGINT AS score_ppm FROM lineitem GROUP BY l_orderkey")
def noisy_and(spark, sf):
    return _parents(spark, sf).select("l_orderkey", F.floor(B.noisy_and(F.col("s"), F.col("w"), F.lit(0.05)) * 1000000 + 0.1234567).alias("score_ppm"))


@query("SELECT l_orderkey, floor((1 - 0.95 * product(1 - (1 - l_discount) * l_quantity / 50)) * 1000000 + 0.1234567)::BIGINT AS score_ppm FROM lineitem GROUP BY l_orderkey")
def noisy_or(spark, sf):
    return _parents(spark, sf).select("l_orderkey", F.floor(B.noisy_or(F.col("s"), F.col("w"), F.lit(0.05)) * 1000000 + 0.1234567).alias("score_ppm"))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """An evidence interval per supplier: the spread of the discounts of its lines, stretched over [0, 1], by nation."""
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_tax").alias("a"), F.count("*").alias("n"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("topic"))
    b = F.pmod(F.col("l_suppkey") * 37, F.lit(100)) / 100
    return li.join(s, "l_suppkey").select(F.col("l_suppkey").cast("string").alias("claim_id"), "topic", b.alias("belief"), F.least(F.lit(1.0), b + F.pmod("n", F.lit(10)) / 100).alias("plausibility"))


_IV = """iv AS (SELECT s_suppkey::VARCHAR AS claim_id, s_nationkey AS topic, (s_suppkey * 37 % 100) / 100 AS b, least(1, (s_suppkey * 37 % 100) / 100 + (n % 10) / 100) AS p
    FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey),
pr AS (SELECT x.claim_id AS a, y.claim_id AS b, x.b AS b1, x.p AS p1, y.b AS b2, y.p AS p2, x.b * (1 - y.p) + (1 - x.p) * y.b AS k FROM iv x JOIN iv y ON x.topic = y.topic AND x.claim_id < y.claim_id)"""


@query(f"WITH {_IV} SELECT a AS claim_a, b AS claim_b, round(k, 6) AS k FROM pr WHERE k >= 0.7")
def detect_interval(spark, sf):
    return contradict.interval_conflicts(intervals(spark, sf)).select("claim_a", "claim_b", F.round("k", 6).alias("k"))


@query(f"WITH {_IV} SELECT a AS claim_a, b AS claim_b, round((b1 * b2 + b1 * (p2 - b2) + (p1 - b1) * b2) / (1 - k), 6) AS belief, round((b1 * b2 + b1 * (p2 - b2) + (p1 - b1) * b2 + (p1 - b1) * (p2 - b2)) / (1 - k), 6) AS plausibility FROM pr WHERE k < 0.99")
def ds_combine(spark, sf):
    iv = intervals(spark, sf)
    x = iv.select("topic", F.col("claim_id").alias("claim_a"), F.col("belief").alias("b1"), F.col("plausibility").alias("p1"))
    y = iv.select("topic", F.col("claim_id").alias("claim_b"), F.col("belief").alias("b2"), F.col("plausibility").alias("p2"))
    j = x.join(y, "topic").where("claim_a < claim_b").withColumn("c", B.combine(F.col("b1"), F.col("p1"), F.col("b2"), F.col("p2"))).where("c IS NOT NULL")
    return j.select("claim_a", "claim_b", F.round("c.belief", 6).alias("belief"), F.round("c.plausibility", 6).alias("plausibility"))


@query(f"WITH {_IV} SELECT claim_id, CASE WHEN p - b > 0.045 THEN 'abstain' ELSE 'act' END AS action FROM iv")
def abstain_ignorance(spark, sf):
    return intervals(spark, sf).select("claim_id", B.ignorance_gate(F.round("belief", 9), F.round("plausibility", 9), 0.045).alias("action"))


@query(f"WITH {_HIST} SELECT claim_id, CASE WHEN score >= 0.7 THEN 'act' WHEN score <= 0.3 THEN 'abstain' ELSE 'escalate' END AS action FROM hist WHERE to_us IS NULL AND score IS NOT NULL")
def abstain_band(spark, sf):
    return history.live(hist(spark, sf)).where("score IS NOT NULL").select("claim_id", B.credence_band(F.col("score")).alias("action"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0.95 WHEN '2-HIGH' THEN 0.7 WHEN '3-MEDIUM' THEN 0.5 WHEN '5-LOW' THEN 0.05 END::DOUBLE AS credence FROM orders""")
def verbal_anchor(spark, sf):
    words = F.create_map(*[F.lit(x) for x in ("1-URGENT", " Almost certain", "2-HIGH", "likely", "3-MEDIUM", "toss-up", "5-LOW", "almost impossible")])
    return table(spark, sf, "orders").select("o_orderkey", B.verbal(words[F.col("o_orderpriority")]).alias("credence"))


@query(f"""WITH RECURSIVE {_FAN}, {_HIST}, lv AS (SELECT claim_id, score FROM hist WHERE to_us IS NULL AND score IS NOT NULL)
    SELECT DISTINCT least(x.claim_id, y.claim_id) AS claim_a, greatest(x.claim_id, y.claim_id) AS claim_b FROM lv x JOIN anc ax ON ax.claim_id = x.claim_id JOIN anc ay ON ay.a = ax.a
    JOIN lv y ON y.claim_id = ay.claim_id WHERE x.score > 0.5 AND y.score < 0.5 AND x.score - y.score >= 0.7""")
def detect_opposition(spark, sf):
    """Opposed claims that share an ancestor over live edges of every kind."""
    return contradict.opposed_lineage(history.live(hist(spark, sf)).select("claim_id", "score"), edges(spark, sf))


_CON = r"""con AS (SELECT DISTINCT least(claim_a, claim_b) AS claim_a, greatest(claim_a, claim_b) AS claim_b FROM claim_relations
    WHERE lower(regexp_replace(relation, '^\s+|\s+$', '', 'g')) = 'contradicts' AND claim_a <> claim_b)"""


@query(f"""WITH {_HIST}, {_CON}, lv AS (SELECT claim_id, score, entrenchment AS e FROM hist WHERE to_us IS NULL)
    SELECT claim_a, claim_b, CASE WHEN a.score IS NULL OR b.score IS NULL THEN 'not-live' WHEN abs(a.e - b.e) < 1e-9 THEN 'tie' ELSE 'resolved' END AS outcome,
    CASE WHEN a.score IS NULL OR b.score IS NULL OR abs(a.e - b.e) < 1e-9 THEN NULL WHEN a.e < b.e THEN claim_a ELSE claim_b END AS loser
    FROM con LEFT JOIN lv a ON a.claim_id = claim_a LEFT JOIN lv b ON b.claim_id = claim_b""")
def resolve_loser(spark, sf):
    r = table(spark, sf, "claim_relations").where(plain(F.col("relation")) == "contradicts").where("claim_a <> claim_b")
    pairs = r.select(F.least("claim_a", "claim_b").alias("claim_a"), F.greatest("claim_a", "claim_b").alias("claim_b")).distinct()
    return contradict.resolution(pairs, history.live(hist(spark, sf))).select("claim_a", "claim_b", "outcome", "loser")


# ---- governance, chains, provenance ----------------------------------------------------------------------------------

_RULES = {
    "hold-axioms": {"action": "declare_contradiction", "effect": "hold", "when": {"all": [{"field": "entrenchment", "op": ">=", "value": 1.0}, {"field": "tier", "op": "!=", "value": "owner"}]}},
    "deny-closed": {"action": "declare_contradiction", "effect": "deny", "when": {"any": [{"field": "status", "op": "not_in", "value": ["active"]}, {"not": {"field": "score", "op": "<=", "value": 0.99}}]}},
}


@query(f"""WITH {_HIST}, {_TIERS} SELECT claim_id, CASE WHEN coalesce(status <> 'active', true) OR NOT coalesce(score <= 0.99, false) THEN 'deny'
    WHEN coalesce(entrenchment >= 1, false) AND coalesce(tier <> 'owner', true) THEN 'hold' ELSE 'allow' END AS effect FROM hist LEFT JOIN tiers USING (writer) WHERE to_us IS NULL""")
def policy_gate(spark, sf):
    ctx = history.live(hist(spark, sf)).join(tiers(spark, sf), "writer", "left")
    cols = {"entrenchment": "number", "tier": "string", "status": "string", "score": "number"}
    return governance.gate(ctx, _RULES, "declare_contradiction", cols).select("claim_id", "effect")


@query(f"""WITH {_HIST}, {_E}, lv AS (SELECT claim_id, entrenchment, CASE WHEN source IS NULL THEN 0.6 ELSE 1 END AS ceil FROM hist WHERE to_us IS NULL),
    sup AS (SELECT e.claim_id, min(l.ceil) AS theirs FROM edge e JOIN lv l ON l.claim_id = e.supports_id GROUP BY e.claim_id)
    SELECT l.claim_id, round(least(l.entrenchment, l.ceil, coalesce(s.theirs, 1)) * 10000)::INTEGER AS eff_bp FROM lv l LEFT JOIN sup s USING (claim_id)""")
def effective_entrenchment(spark, sf):
    c = history.live(hist(spark, sf)).select("claim_id", "entrenchment", F.when(F.col("source").isNull(), "unsourced").otherwise("public").alias("graph"))
    ceil = spark.createDataFrame([("unsourced", 0.6)], "graph string, ceiling double")
    return governance.effective_entrenchment(c, edges(spark, sf), ceil).select("claim_id", bp("effective").alias("eff_bp"))


@query(f"""WITH {_REC} SELECT store, j->>'key_id' AS key_id, j->>'role' AS role, seq AS enrolled_seq FROM rec WHERE type = 'key_enrollment'""")
def governance_windows(spark, sf):
    return governance.key_windows(log(spark, sf)).where("revoked_seq IS NULL").select("store", "key_id", "role", "enrolled_seq")


@query(f"""WITH {_REC} SELECT r.store, r.seq, CASE WHEN r.seq > 1 AND p.hash IS NULL THEN 'BadSequence' ELSE 'BadPrevHash' END AS problem FROM rec r LEFT JOIN rec p ON p.store = r.store AND p.seq = r.seq - 1
    WHERE r.prev_hash IS DISTINCT FROM CASE WHEN r.seq = 1 THEN repeat('0', 64) ELSE p.hash END""")
def chain_problems(spark, sf):
    return chain.chain_problems(log(spark, sf))


@query(f"WITH {_HASHED} SELECT store, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM hashed GROUP BY store")
def chain_hashes(spark, sf):
    r = chain.rehashed(log(spark, sf))
    return r.groupBy("store").agg(F.count("*").alias("n"), F.sum(F.col("hash_ok").cast("long")).alias("n_ok"))


@query(f"WITH {_REC} SELECT store, count(*) AS n, max(seq) AS head_seq, arg_max(hash, seq) AS head_hash FROM rec GROUP BY store")
def chain_heads(spark, sf):
    return chain.heads(log(spark, sf))


_MERKLE = """
lf AS (SELECT store, (seq - 1) // 1024 AS no, (seq - 1) % 1024 AS i, sha256(from_hex('00' || hash)) AS h FROM rec),
full_ AS (SELECT store, no FROM lf GROUP BY store, no HAVING count(*) = 1024), lv0 AS (SELECT lf.* FROM lf JOIN full_ USING (store, no))""" + "".join(
    f""", lv{k + 1} AS (SELECT a.store, a.no, a.i // 2 AS i, sha256(from_hex('01' || a.h || b.h)) AS h FROM lv{k} a JOIN lv{k} b ON b.store = a.store AND b.no = a.no AND a.i % 2 = 0 AND b.i = a.i + 1)"""
    for k in range(10)
)


@query(f"WITH {_REC}, {_MERKLE} SELECT store, no, no * 1024 + 1 AS first_seq, no * 1024 + 1024 AS last_seq, h AS root FROM lv10")
def merkle_segments(spark, sf):
    return chain.segments(log(spark, sf))


@query(f"""WITH {_REC}, {_MERKLE}, cp AS (SELECT store, no, h AS root, lag(h) OVER (PARTITION BY store ORDER BY no) AS before FROM lv10)
    SELECT store, no, root, coalesce(before, sha256('')) AS prev_root, false AS broken FROM cp""")
def consistency_links(spark, sf):
    """Checkpoints with the root before them, and whether they follow on it."""
    cp = chain.checkpoints(log(spark, sf))
    return cp.join(chain.link_problems(cp).withColumn("broken", F.lit(True)), ["store", "no"], "left").select("store", "no", "root", "prev_root", F.coalesce("broken", F.lit(False)).alias("broken"))


@query(f"""WITH {_REC}, {_MERKLE} SELECT r.store, r.seq, v.h AS root, 10 AS steps FROM rec r JOIN lv10 v ON v.store = r.store AND v.no = (r.seq - 1) // 1024 WHERE r.type = 'assert'""")
def inclusion_proofs(spark, sf):
    """Proofs for the asserts in full segments."""
    lg = log(spark, sf)
    p = chain.inclusion(lg, lg.where("type = 'assert'").select("store", "seq"))
    return p.select("store", "seq", "root", F.size("proof").alias("steps"))


@query(f"WITH {_REC} SELECT store, 'record-' || seq AS entity, type, hash FROM rec")
def prov_entities(spark, sf):
    return provenance.entities(log(spark, sf))


@query(f"""WITH {_REC}, a AS (SELECT store, actor, min(seq) AS f, regexp_replace(actor, '[^A-Za-z0-9._-]', '-', 'g') AS slug FROM rec GROUP BY store, actor),
    n AS (SELECT *, row_number() OVER (PARTITION BY store, slug ORDER BY f) AS k FROM a) SELECT store, actor, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS agent FROM n""")
def prov_agents(spark, sf):
    return provenance.agents(log(spark, sf))


@query(f"""WITH {_REC}, c AS (SELECT store, seq, coalesce(j->>'claim_id', j->>'old_claim_id') AS claim_id FROM rec)
    SELECT * FROM (SELECT store, seq, lag(seq) OVER (PARTITION BY store, claim_id ORDER BY seq) AS used FROM c WHERE claim_id IS NOT NULL) WHERE used IS NOT NULL""")
def prov_trail(spark, sf):
    return provenance.claim_trail(log(spark, sf))


@query(f"""WITH {_VER}, m AS (SELECT store, CASE WHEN type = 'supersede' THEN j->>'old_claim_id' ELSE j->>'claim_id' END AS claim_id, seq, type FROM rec WHERE type IN ('assert', 'supersede', 'claim_status_changed')),
    st AS (SELECT store, claim_id, arg_max(type, seq) AS last FROM m WHERE claim_id IS NOT NULL GROUP BY 1, 2), lv AS (SELECT DISTINCT store, claim_id FROM ver WHERE txn_to IS NULL)
    SELECT st.store, st.claim_id, CASE WHEN st.last = 'assert' THEN 'asserted-not-live' ELSE 'ended-but-live' END AS problem FROM st LEFT JOIN lv USING (store, claim_id)
    WHERE (st.last = 'assert') <> (lv.claim_id IS NOT NULL)""".replace("LEFT JOIN lv USING (store, claim_id)", "LEFT JOIN lv ON lv.store = st.store AND lv.claim_id = st.claim_id"))
def store_violations(spark, sf):
    """Claims whose projection disagrees with their last structural event: none in a sound fold."""
    lg = log(spark, sf)
    key = F.when(F.col("type") == "supersede", F.col("p.old_claim_id")).otherwise(F.col("p.claim_id"))
    st = lg.where(F.col("type").isin("assert", "supersede", "claim_status_changed")).groupBy("store", key.alias("claim_id")).agg(F.max_by("type", "seq").alias("last")).where("claim_id IS NOT NULL")
    live = history.live(fold.claim_versions(lg), "txn_to").select("store", "claim_id", F.lit(True).alias("live")).distinct()
    j = st.join(live, ["store", "claim_id"], "left").withColumn("live", F.coalesce("live", F.lit(False)))
    j = j.where((F.col("last") == "assert") != F.col("live"))
    return j.select("store", "claim_id", F.when(F.col("last") == "assert", "asserted-not-live").otherwise("ended-but-live").alias("problem"))
