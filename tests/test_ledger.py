import json
import random

import pytest
from pyspark.sql import functions as F

from beliefloom.functions import canonical as C
from beliefloom.operators import analytics as A
from beliefloom.operators import chain, contradict, fold, governance, graph, history, provenance
from beliefloom.operators.ordered import running
from beliefloom.plans import lql
from beliefloom.sources import logs

REC = "store string, seq long, t string, actor string, type string, payload string, prev_hash string, hash string, sig string"


def records(spark, events, store="s", sign=None):
    """events: (actor, type, payload); a proper chain with one tick per record."""
    out, prev = [], C.GENESIS
    for i, (actor, kind, payload) in enumerate(events, 1):
        t = f"2024-01-01T00:00:{i:02d}Z" if i < 60 else f"2024-01-01T01:{i // 60:02d}:{i % 60:02d}Z"
        h = C.record_hash(i, t, actor, kind, payload, prev)
        out.append((store, i, t, actor, kind, json.dumps(payload), prev, h, C.sign(sign, bytes.fromhex(h)).hex() if sign else None))
        prev = h
    return out


def a(c, prior, **more):
    return ("ann", "assert", {"claim_id": c, "statement": f"about {c}", "prior": prior, **more})


def r(c, old, new, actor="ann", **more):
    return (actor, "score_revision", {"claim_id": c, "old_score": old, "new_score": new, **more})


def test_claim_versions(spark):
    ev = [
        a("A", 0.5, writer="w"), r("A", 0.5, 0.9), ("ann", "entrenchment_set", {"claim_id": "A", "old": 0.25, "new": 1.0}), a("B", 0.4, entrenchment=0.75),
        ("ann", "supersede", {"old_claim_id": "A", "new_claim_id": "B", "reason": "x", "source": "y"}), r("A", 0.9, 0.1), r("Z", 0.1, 0.2),
        ("ann", "claim_status_changed", {"claim_id": "A", "status": "dead"}), a("A", 0.3),
    ]
    rows = records(spark, ev)
    rows += [rows[1], (*rows[3][:5], json.dumps(dict(reversed(json.loads(rows[3][5]).items())), indent=1), *rows[3][6:]), (*rows[4][:5], '{"old_cl', *rows[4][6:])]
    for segment in (1 << 20, 2):
        log = logs.clean_log(spark.createDataFrame(rows, REC))
        got = {(x.claim_id, x.seq, x.score, x.entrenchment, x.status, x.txn_to is None) for x in fold.claim_versions(log).collect()}
        assert got == {
            ("A", 1, 0.5, 0.25, "active", False), ("A", 2, 0.9, 0.25, "active", False), ("A", 3, 0.9, 1.0, "superseded", False),
            ("B", 4, 0.4, 0.75, "active", True), ("A", 9, 0.3, 0.5, "active", True),
        }
    m = {x.claim_id: (x.confidence, x.status, x.superseded_by) for x in fold.matrix(log).collect()}
    assert m == {"A": (0.3, "active", "B"), "B": (0.4, "active", None)}


def test_running_is_the_same_in_segments(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, n long, v int, w string")
    out = [sorted(map(tuple, running(df, ["k"], "n", {"last": F.col("v")}, {"next": F.col("w")}, segment=s).select("k", "n", "last", "next").collect())) for s in (1 << 20, 3, 1)]
    assert out[0] == out[1] == out[2]
    want, last = [], {}
    for k, n, v, _ in rows:
        last[k] = v if v is not None else last.get(k)
        later = [x for x in rows if x[0] == k and x[1] > n]
        want.append((k, n, last[k], later[0][3] if later else None))
    assert out[0] == sorted(want, key=lambda x: (x[0], x[1]))


def test_support_and_decisions(spark):
    sup = lambda x, y, **m: ("ann", "support", {"claim_id": x, "supports_id": y, "kind": "deductive", "p_given": 0.9, "p_given_not": 0.2, **m})
    ev = [a("A", 0.5), a("B", 0.5), sup("A", "B"), sup("A", "B"), ("ann", "retract_support", {"claim_id": "A", "supports_id": "B"}), sup("A", "B", strength=0.5), ("ann", "decision", {"decision_id": "D", "label": "go", "basis": ["B", "ghost", "A", "B"]})]
    log = logs.clean_log(spark.createDataFrame(records(spark, ev), REC))
    assert sorted((x.seq, x.txn_to is None, x.strength) for x in fold.support_edges(log).collect()) == [(3, False, 1.0), (4, False, 1.0), (6, True, 0.5)]
    assert [x.basis for x in fold.decisions(log).collect()] == [["B", "A"]]
    assert {(x.claim_id, x.seq) for x in fold.evidence(log).collect() if x.claim_id == "B"} == {("B", 2), ("B", 3), ("B", 4), ("B", 5), ("B", 6), ("B", 7)}
    assert logs.unknown_types(log).count() == 0


def churn_of(spark, scores, band=0.05):
    rows = [("c", i, float(o), float(n)) for i, (o, n) in enumerate(zip(scores, scores[1:]))]
    h = A.last_revisions(spark.createDataFrame(rows, "claim_id string, seq long, old_score double, new_score double"), ["claim_id"])
    return A.churn(h, F.lit(band)).first()


def test_churn(spark):
    jitter = churn_of(spark, [0.5 + 0.01 * (i % 2) for i in range(11)])
    assert (jitter.material_moves, jitter.material_churn, jitter.raw) == (0, 0, 9)
    swing = churn_of(spark, [0.3 + 0.4 * (i % 2) for i in range(11)])
    assert (swing.material_moves, swing.material_churn) == (10, 9)
    once = churn_of(spark, [0.1, 0.5, 0.2])
    assert (once.material_moves, once.material_churn) == (2, 1)
    one_way = churn_of(spark, [0.1, 0.2, 0.3, 0.4, 0.5])
    assert (one_way.raw, one_way.conflict_balance) == (0, 0.0) and one_way.gross_travel == pytest.approx(0.4)


def test_learning(spark):
    cases = spark.createDataFrame([("t", 0.9, 1)] * 3 + [("f", 0.9, 0)] * 3 + [("few", 0.9, 1)] + [("m", 0.9, 1), ("m", 0.9, 1), ("m", 0.2, 0)], "claim_id string, score double, outcome int")
    live = spark.createDataFrame([(c, 0.5) for c in ("t", "f", "few", "m")], "claim_id string, entrenchment double")
    got = {x.claim_id: x.new for x in A.learned_entrenchment(cases, live).collect()}
    assert got == pytest.approx({"t": 0.99, "f": 0.19, "m": 0.98})
    v = spark.createDataFrame([("few", i, 0.9 if i % 2 else 0.1) for i in range(6)] + [("t", i, 0.1 * i) for i in range(9)], "claim_id string, from_us long, score double")
    d = A.stability_decay(v, live, A.learned_entrenchment(cases, live)).collect()
    assert [(x.claim_id, x.versions, x.flips, x.new) for x in d] == [("few", 6, 5, 0.25)]
    bars = A.kill_bars(spark.createDataFrame([(0.3, None, 0.5, 100.0)], "brier double, override_rate double, trigger_recall double, max_fanout double"))
    assert {(x.criterion, x.breached) for x in bars.collect()} == {("brier", True), ("trigger_recall", True), ("max_fanout", False)}


def brute_reach(edges, root):
    dist, count, layer = {root: 0}, {root: 1}, [root]
    while layer:
        nxt = {}
        for s, t in set(edges):
            if s in layer and t not in dist:
                nxt[t] = nxt.get(t, 0) + count[s]
        for t, k in nxt.items():
            dist[t], count[t] = dist[layer[0]] + 1, k
        layer = list(nxt)
    return {(n, dist[n], count[n]) for n in dist if n != root}


@pytest.mark.parametrize("kernel", [True, False])
def test_graph(spark, kernel, monkeypatch):
    if not kernel:
        monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    rng = random.Random(4)
    nodes = [f"n{i}" for i in range(14)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(26)]
    e = spark.createDataFrame(pairs, "supports_id string, claim_id string")
    roots = spark.createDataFrame([("n0",), ("n3",)], "root string")
    got = graph.reach(e, "supports_id", "claim_id", roots).collect()
    for root in ("n0", "n3"):
        assert {(x.node, x.distance, x.path_count) for x in got if x.root == root} == brute_reach(pairs, root)
    c = {(x.supports_id, x.claim_id): x.distance for x in graph.closure(e, "supports_id", "claim_id").collect()}
    for s in nodes:
        want = {t: d for t, d, _ in brute_reach(pairs, s)}
        assert {t: d for (x, t), d in c.items() if x == s and t != s} == want
    dec = spark.createDataFrame([("D1", ["n0"]), ("D2", ["nowhere"])], "decision_id string, basis array<string>")
    hit = [(x.id, x.distance) for x in graph.impact(e, roots.where("root = 'n0'"), dec).where("kind = 'decision'").collect()]
    assert hit == [("D1", 1)]
    kept, why = graph.capped(graph.impact(e, roots, dec), max_results=2)
    assert kept.count() == 2 and why == ["max_results"]


def test_revision_walk(spark):
    claims = {"fact": (0.9, 0.05, False), "c": (0.6, 0.05, False), "d": (0.5, 0.9, True)}
    edges = [(1, 0, "c", "fact", 0.95, 0.30, 1.0), (2, 0, "d", "c", 0.9, 0.1, 1.0)]
    got = graph.propagate(claims, edges, {}, "fact", 0.9)
    assert [(x[0], x[3]) for x in got] == [("c", True), ("d", True)] and got[0][2] == pytest.approx(0.885)
    assert graph.propagate({"f": (0.5, 0, False), "a": (0.5, 0, False), "b": (0.5, 0, False)}, [(1, 0, "a", "f", 0.6, 0.4, 1.0), (2, 0, "b", "a", 1.0, 0.0, 1.0)], {}, "f", 0.51) == []
    joint = graph.propagate({"x": (0.99, 0, False), "y": (0.99, 0, False), "z": (0.5, 0, False)}, [(1, 0, "z", "x", 0.9, 0.1, 1.0), (2, 0, "z", "y", 0.9, 0.1, 1.0)], {"z": ("noisy-and", 0.0)}, "x", 0.01)
    assert joint[0][2] == pytest.approx(0.01 * 0.99)
    cdf = spark.createDataFrame([(k, *v) for k, v in claims.items()], "claim_id string, score double, materiality double, critical boolean")
    edf = spark.createDataFrame(edges, "seq long, from_us long, claim_id string, supports_id string, p_given double, p_given_not double, strength double")
    out = graph.revisit(cdf, edf, spark.createDataFrame([("fact", 0.9)], "root string, score double")).orderBy("position").collect()
    assert [(x.claim_id, x.new) for x in out] == [(x[0], x[2]) for x in got]


def test_contradictions(spark):
    rng = random.Random(6)
    claims = [(f"c{i}", rng.random()) for i in range(40)] + [("lone", 0.99), ("none", None)]
    anc = [(f"c{i}", f"p{rng.randrange(5)}") for i in range(40) for _ in range(2)]
    got = {tuple(x) for x in contradict.opposed_siblings(spark.createDataFrame(claims, "claim_id string, score double"), spark.createDataFrame(anc, "claim_id string, ancestor string").distinct()).collect()}
    score, up = dict(claims), {}
    for c, p in anc:
        up.setdefault(c, set()).add(p)
    assert got == {(x, y) for x in up for y in up if x < y and up[x] & up[y] and (score[x] - 0.5) * (score[y] - 0.5) < 0 and abs(score[x] - score[y]) >= 0.7}
    iv = []
    for i in range(80):
        b = rng.choice([0.0, rng.random(), 0.9])
        iv.append((f"c{i}", f"t{i % 3}", b, b + (1 - b) * rng.choice([0.0, rng.random()])))
    got = {(x.claim_a, x.claim_b) for x in contradict.interval_conflicts(spark.createDataFrame(iv, "claim_id string, topic string, belief double, plausibility double")).collect()}
    k = lambda x, y: x[2] * (1 - y[3]) + (1 - x[3]) * y[2]
    assert got == {(x[0], y[0]) for x in iv for y in iv if x[0] < y[0] and x[1] == y[1] and k(x, y) >= 0.7}
    res = contradict.resolution(spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "gone")], "claim_a string, claim_b string"), spark.createDataFrame([("a", 0.9, 0.5), ("b", 0.2, 0.75), ("c", 0.1, 0.5)], "claim_id string, score double, entrenchment double"))
    assert {(x.claim_b, x.loser, x.outcome) for x in res.collect()} == {("b", "a", "resolved"), ("c", None, "tie"), ("gone", None, "not-live")}


def test_predicates(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 0.5, "owner"), (3, None, "guest")], "i int, ent double, tier string")
    cols = {"ent": "number", "tier": "string"}
    hold = lambda p: {x.i for x in df.where(governance.predicate(p, cols)).collect()}
    assert hold({"all": [{"field": "ent", "op": ">=", "value": 1.0}, {"field": "tier", "op": "!=", "value": "owner"}]}) == {1}
    assert hold({"not": {"field": "missing", "op": "==", "value": 1}}) == {1, 2, 3}
    assert hold({"field": "tier", "op": "not_in", "value": ["owner"]}) == {1, 3}
    assert hold({"field": "tier", "op": "<", "value": 3}) == set() and hold({"field": "ent", "op": "!=", "value": "x"}) == {1, 2, 3}
    for bad in ({}, {"field": "x", "op": "~", "value": 1}, {"all": []}, {"all": [1], "any": [1]}):
        with pytest.raises(ValueError):
            governance.validate_predicate(bad)
    with pytest.raises(ValueError):
        governance.validate({"action": "resolve_contradiction", "effect": "hold", "when": {"field": "x", "op": "==", "value": 1}})


def test_chain(spark, tmp_path):
    seed = b"\7" * 32
    ev = [("root", "key_enrollment", {"key_id": "ann", "pubkey": C.public_key(seed).hex(), "role": "writer"})] + [a(f"C{i}", 0.5) for i in range(9)]
    rows = records(spark, ev, sign=seed)
    log = logs.clean_log(spark.createDataFrame(rows, REC))
    assert chain.chain_problems(log).count() == 0
    bad = list(rows)
    bad[4] = (*bad[4][:5], bad[4][5].replace("0.5", "0.6"), *bad[4][6:])
    bad[6] = (*bad[6][:6], "0" * 64, *bad[6][7:])
    del bad[2]
    got = {(x.seq, x.problem) for x in chain.chain_problems(logs.clean_log(spark.createDataFrame(bad, REC))).collect()}
    assert got == {(4, "BadSequence"), (5, "BadHash"), (7, "BadPrevHash")}
    cp = chain.checkpoints(log, 4)
    assert sorted((x.no, x.root) for x in cp.collect()) == [(i, c["root"]) for i, c in enumerate(logs.checkpoints([x[7] for x in rows], 4))]
    assert chain.link_problems(cp).count() == 0
    for p in chain.inclusion(log, spark.createDataFrame([("s", 2), ("s", 7), ("s", 10)], "store string, seq long"), 4).collect():
        assert C.verify_inclusion(bytes.fromhex(rows[p.seq - 1][7]), (p.seq - 1) % 4, 4, [bytes.fromhex(x) for x in p.proof], bytes.fromhex(p.root))
    sig = chain.signatures(log, governance.key_windows(log)).collect()
    assert {x.seq for x in sig} == set(range(2, 11)) and all(x.valid for x in sig)
    path = tmp_path / "events.log"
    logs.append_chain(str(path), [("2024-01-01T00:00:00Z", "ann", "note", {"x": 1.5, "ö": [True, None]})] * 5, seed)
    back = logs.read_chain(spark, str(path))
    assert back.where("crc_ok").count() == 5 and chain.chain_problems(back).count() == 0
    logs.write_snapshot(str(path), str(tmp_path / "bundle"), 2)
    assert logs.verify_snapshot(str(tmp_path / "bundle")) == []
    (tmp_path / "bundle" / "events.log").write_text(path.read_text().replace("1.5", "1.6"))
    assert logs.verify_snapshot(str(tmp_path / "bundle"))
    lines = [json.dumps({"event_id": f"E{i}", "t": "2024-01-01T00:00:00Z", "actor": "x", "type": "outcome", "payload": {"claim_id": "A", "outcome": True}}) for i in range(3)]
    (tmp_path / "log.jsonl").write_text("\n\n".join(lines) + "\n")
    assert [x.seq for x in logs.read_jsonl(spark, str(tmp_path / "log.jsonl")).orderBy("seq").collect()] == [1, 2, 3]
    (tmp_path / "bad.jsonl").write_text(lines[0] + "\n{oops\n")
    with pytest.raises(Exception, match="does not parse"):
        logs.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_provenance(spark):
    ev = [("a b", "note", {}), ("a.b", "note", {"derived_from": 1}), ("a/b", "note", {"derived_from": [1, 2, 99]})]
    log = logs.clean_log(spark.createDataFrame(records(spark, ev), REC))
    assert {(x.actor, x.agent) for x in provenance.agents(log).collect()} == {("a b", "a-b"), ("a.b", "a.b"), ("a/b", "a-b-2")}
    assert {(x.seq, x.used) for x in provenance.derivations(log).collect()} == {(2, 1), (3, 1), (3, 2)}
    assert provenance.document(log).count() == 4 * 3 + 3 + 3


def test_history(spark):
    rows = [("A", "2024-01-01T00:00:00Z", None, 0.9), ("A", "2024-02-01 00:00:00", "2024-03-01T00:00:00Z", 0.3), ("A", "2024-02-01T01:00:00+01:00", None, 0.3), ("B", None, None, 0.1)]
    h = history.history(spark.createDataFrame(rows, "claim_id string, txn_from string, txn_to string, score double")).cache()
    assert h.count() == 2 and history.live(h).count() == 0
    at = lambda t: [x.score for x in history.believed_at(h, lql.micros(t)).collect()]
    assert at("2024-01-15T00:00:00Z") == [0.9] and at("2024-02-01T00:00:00Z") == [0.3] and at("2024-03-01T00:00:00Z") == []


@pytest.mark.parametrize("text", ["", "CLAIMS WHERE", "CLAIMS WHERE x = 1", "CLAIMS WHERE score = abc", "CLAIM", "AS_OF 2024-01-01 HEALTH", "AS_OF soon CLAIMS", "IMPACT a PROPAGATED 1", "IMPACT a PROPAGATED TO 3", "WHY a b", "EVENTS WHERE type ~ 3", "CLAIMS WHERE critical < true", "CLAIMS WHERE score > 1 AND"])
def test_parse_errors(text):
    with pytest.raises(lql.ParseError) as e:
        lql.parse(text)
    assert e.value.position >= 0


def test_precedence_and_quotes():
    f = lql.parse("CLAIMS WHERE score > 0.4 OR status = 'it''s' AND critical = true").filter
    assert f == ("or", ("cmp", "score", ">", 0.4), ("and", ("cmp", "status", "=", "it's"), ("cmp", "critical", "=", True)))
