"""Revision passes, what they touch, contradictions resolved, impact with paths, against small brute-force versions."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from beliefloom.functions import belief as B
from beliefloom.operators import graph, revision
from beliefloom.sources.logs import PAYLOAD

T = "2025-01-01T00:00:00Z"
CLAIMS = "claim_id string, score double, materiality double, critical boolean, entrenchment double"
EDGES = "claim_id string, supports_id string, p_given double, p_given_not double, strength double, from_us long, seq long"


def walk(claims, edges, combos, root, to, cutoff):
    """One pass, as specified: breadth first by attachment, joint or last-supporter-wins, changes below the cutoff stay."""
    score = {c[0]: c[1] for c in claims}
    edges = sorted(edges, key=lambda e: e[6])
    order, seen, todo = [], {root}, [root]
    while todo:
        at = todo.pop(0)
        for e in edges:
            if e[1] == at and e[0] not in seen:
                seen.add(e[0])
                order.append(e[0])
                todo.append(e[0])
    moved, out = {root: to}, []
    for c in order:
        mine = [e for e in edges if e[0] == c]
        if c not in score or not any(e[1] in moved for e in mine):
            continue
        if c in combos:
            kind, leak = combos[c]
            x = 1.0
            for e in {e[1]: e for e in mine}.values():
                p = moved.get(e[1], score.get(e[1]))
                if p is not None:
                    x *= e[4] * p + 1 - e[4] if kind == "noisy-and" else 1 - e[4] * p
            new = leak + (1 - leak) * x if kind == "noisy-and" else 1 - (1 - leak) * x
        else:
            for e in mine:
                if e[1] in moved:
                    new = e[2] * moved[e[1]] + e[3] * (1 - moved[e[1]])
        if abs(new - score[c]) >= cutoff:
            moved[c] = new
            out.append((c, round(score[c], 9), round(new, 9)))
    return out, order


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_report_against_brute_force(spark, seed):
    rng = random.Random(seed)
    ids = [f"c{i:02d}" for i in range(30)]
    claims = [(c, round(rng.random(), 3), 0.05, rng.random() < 0.2, 0.5) for c in ids[:27]]  # three ids are not live
    edges = [(ids[b], ids[a], round(rng.random(), 2), round(rng.random(), 2), round(rng.random(), 2), 100 - i, i) for i, (a, b) in enumerate(rng.sample([(a, b) for a in range(30) for b in range(a + 1, 30)], 70))]
    combos = {c: (rng.choice(["noisy-and", "noisy-or"]), 0.1) for c in rng.sample(ids, 6)}
    c, e = spark.createDataFrame(claims, CLAIMS), spark.createDataFrame([(*x[:5], x[6], x[6]) for x in edges], EDGES)
    k = spark.createDataFrame([(a, *b) for a, b in combos.items()], "claim_id string, combo string, leak double")
    roots = spark.createDataFrame([("c00", 0.0), ("c03", 0.9)], "root string, score double")
    moves, summary = revision.report(c, e, roots, k)
    s = {r.root: r for r in summary.collect()}
    for root, to in (("c00", 0.0), ("c03", 0.9)):
        want, order = walk(claims, edges, combos, root, to, 0.005)
        got = [(r.claim_id, round(r.old, 9), round(r.new, 9)) for r in moves.where(F.col("root") == root).orderBy("position").collect()]
        assert got == want and want
        live = {x[0] for x in claims}
        assert (s[root].closure_size, s[root].n_revisited, s[root].n_cutoff) == (len(order), len(want), sum(x in live for x in order) - len(want))
    ev = revision.events(moves, summary, "system", T).where("root = 'c00'").orderBy("position").collect()
    assert [json.loads(r.payload)["claim_id"] for r in ev[:-1]] == [x[0] for x in walk(claims, edges, combos, "c00", 0.0, 0.005)[0]]
    assert ev[-1].type == "revisit" and json.loads(ev[-1].payload)["closure_size"] == s["c00"].closure_size
    exact = graph.revisit(c, e, roots, k, cutoff=0.0)
    q = {r.root: r for r in revision.trigger_quality(moves, exact).collect()}
    true = {x[0] for x in walk(claims, edges, combos, "c00", 0.0, 0.0)[0] if abs(x[2] - x[1]) >= 0.05}
    hit = {x[0] for x in walk(claims, edges, combos, "c00", 0.0, 0.005)[0]}
    assert q["c00"].n_truth == len(true) and abs(q["c00"].recall - len(true & hit) / max(len(true), 1)) < 1e-9


def test_evidence_and_scores_by_hand(spark):
    c = spark.createDataFrame([("a", 0.5, 0.05, False, 0.5), ("b", 0.5, 0.05, False, 0.5)], CLAIMS)
    e = spark.createDataFrame([("b", "a", 0.9, 0.1, 1.0, 1, 1), ("a", "new", 0.8, 0.2, 1.0, 2, 2)], EDGES)
    ev, _ = revision.ingest_evidence(c, e, spark.createDataFrame([("new", "seen", 1.0)], "claim_id string, statement string, credence double"), T)
    rows = ev.orderBy("position").collect()
    assert [r.type for r in rows] == ["assert", "score_revision", "score_revision", "revisit"]
    assert json.loads(rows[0].payload) == {"claim_id": "new", "statement": "seen", "prior": 1.0, "entrenchment": 1.0}
    assert abs(json.loads(rows[2].payload)["new_score"] - 0.74) < 1e-9
    ev, got = revision.manual_score(c, e, spark.createDataFrame([("a", 0.0), ("gone", 1.0)], "claim_id string, score double"), T)
    assert [tuple(r) for r in got.collect()] == [("a", 0.5, 0.0, 1)]
    first = ev.orderBy("position").first()
    assert first.actor == "human" and "triggering_event_id" not in json.loads(first.payload)
    d = spark.createDataFrame([("D1", ["b", "x"]), ("D2", ["x"]), ("D3", ["a"])], "decision_id string, basis array<string>")
    roots = spark.createDataFrame([("a", 0.0)], "root string, score double")
    moves, _ = revision.report(c, e, roots)
    assert {r.decision_id for r in revision.decisions_affected(moves, d).collect()} == {"D1"}
    assert {r.decision_id for r in revision.decisions_affected(moves, d, roots).collect()} == {"D1", "D3"}


def test_resolution_branches(spark):
    rows = [("E1", "contradiction", {"claim_a": "hi", "claim_b": "lo", "p_loser_given_winner": 0.2}), ("E2", "contradiction", {"claim_a": "hi", "claim_b": "hi2"}), ("E3", "contradiction", {"claim_a": "hi", "claim_b": "gone"}),
            ("E4", "contradiction_held", {"claim_a": "lo", "claim_b": "hi"}), ("E5", "contradiction", {"claim_a": "lo", "claim_b": "hi2"}), ("E6", "contradiction_resolved", {"contradiction_id": "E5"}), ("E7", "contradiction", {"claim_a": "hi2", "claim_b": "lo"})]
    lg = spark.createDataFrame([(i, k, T, json.dumps(p)) for i, k, p in rows], "event_id string, type string, t string, payload string").withColumn("p", F.from_json("payload", PAYLOAD))
    claims = spark.createDataFrame([("hi", 0.9, 0.05, False, 0.9), ("hi2", 0.8, 0.05, False, 0.9), ("lo", 0.6, 0.05, False, 0.4)], CLAIMS)
    out, ev = revision.resolve(lg, claims, spark.createDataFrame([], EDGES), T, denied=spark.createDataFrame([("E7",)], "event_id string"))
    got = {r.event_id: r for r in out.collect()}
    assert {k: r.outcome for k, r in got.items()} == {"E1": "resolved", "E2": "tie", "E3": "not-live", "E4": "held", "E5": "already", "E7": "denied"}
    assert (got["E1"].loser, got["E1"].winner) == ("lo", "hi") and abs(got["E1"].new - (0.2 * 0.9 + 0.6 * 0.1)) < 1e-12 and got["E2"].loser is None
    kinds = {(r.event_id, r.position): r.type for r in ev.collect()}
    assert kinds == {("E1", 0): "score_revision", ("E1", 1): "contract", ("E1", 2): "contradiction_resolved", ("E2", 0): "contradiction_unresolved", ("E3", 0): "contradiction_unresolved", ("E7", 0): "policy_denied"}


def test_impact_with_paths_and_caps(spark):
    links = [("b1", "a"), ("b2", "a"), ("b3", "a"), ("c", "b1"), ("c", "b2"), ("c", "b3"), ("d", "c"), ("e", "d"), ("a", "e")]
    e = spark.createDataFrame([(*x, 1.0, 0.0, 1.0, i, i) for i, x in enumerate(links)], EDGES)
    d = spark.createDataFrame([("D1", ["c", "e"]), ("D2", ["zzz"]), ("D3", ["a"])], "decision_id string, basis array<string>")
    nodes, why = revision.impact_report(e, "a", d)
    got = {r.id: r for r in nodes.collect()}
    assert why == [] and {k: (r.kind, r.distance, r.path_count) for k, r in got.items()} == {
        "b1": ("claim", 1, 1), "b2": ("claim", 1, 1), "b3": ("claim", 1, 1), "c": ("claim", 2, 3), "d": ("claim", 3, 3), "e": ("claim", 4, 3), "D1": ("decision", 3, 3), "D3": ("decision", 1, 1)}
    assert got["c"].paths == [["a", "b1", "c"], ["a", "b2", "c"], ["a", "b3", "c"]] and got["D1"].paths[0] == ["a", "b1", "c", "D1"] and got["D3"].paths == [["a", "D3"]]
    nodes, why = revision.impact_report(e, "a", d, max_depth=3, max_results=5, most=2)
    assert why == ["max_depth", "max_results", "paths"] and [r.id for r in nodes.orderBy("distance", "id").collect()] == ["D3", "b1", "b2", "b3", "c"]
    _, why = revision.impact_report(e, "a", d, ids=10)
    assert why == ["paths"]


def test_belief_functions(spark):
    m = lambda rows: spark.createDataFrame(rows, "k string, subset long, mass double")
    out = B.dempster(m([("x", 1, 0.6), ("x", 7, 0.4), ("y", 1, 1.0), ("z", 1, 1.0)]), m([("x", 2, 0.5), ("x", 3, 0.5), ("y", 2, 1.0)]), ["k"]).collect()
    got = {(r.k, r.subset): round(r.mass, 6) if r.mass is not None else None for r in out}
    assert got == {("x", 1): round(0.3 / 0.7, 6), ("x", 2): round(0.2 / 0.7, 6), ("x", 3): round(0.2 / 0.7, 6), ("y", None): None}
    with pytest.raises(Exception, match="masses sum"):
        B.dempster(m([("x", 1, 0.6)]), m([("x", 1, 1.0)]), ["k"]).collect()
    df = spark.sql("SELECT 0.5D AS p, array(named_struct('says_true', true, 'accuracy', 0.8D), named_struct('says_true', false, 'accuracy', 0.8D)) AS r")
    assert abs(df.select(B.bayes_path(F.col("p"), F.col("r"))).first()[0] - 0.5) < 1e-12
    assert df.select(B.trust(F.lit(0.8), F.lit(3), F.lit(0))).first()[0] == 0.8
    assert df.select(B.elicit_pair(F.lit("Unlikely"), F.lit("likely"))).first()[0].counter


@pytest.mark.parametrize("seed", range(4))
def test_quality_counts_what_the_walks_find(spark, seed):
    """Cycles, edges inside a layer, equal times, claims that are not live and repeated edges, against the rows of both walks."""
    rng = random.Random(seed)
    ids = [f"c{i:03d}" for i in range(150)]
    claims = [(c, round(rng.random(), 3), rng.choice([0.05, 0.3]), rng.random() < 0.2, 0.5) for c in ids if rng.random() < 0.9]
    some = lambda: (rng.choice(ids), rng.choice(ids), round(rng.random(), 2), round(rng.random(), 2), 1.0, rng.randrange(20), rng.randrange(20))
    edges = [some() for _ in range((160, 300, 500, 900)[seed])]
    c, e = spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(edges, EDGES)
    roots = spark.createDataFrame([(x, rng.choice([0.0, 0.9])) for x in [*ids, "unknown"]], "root string, score double")
    want = revision.trigger_quality(graph.revisit(c, e, roots), graph.revisit(c, e, roots, cutoff=0.0))
    got = revision.quality(c, e, roots)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50
    assert revision.quality(c, e.limit(0), roots).count() == 0 and revision.quality(c, e, roots.limit(0)).count() == 0


def test_quality_of_many_roots(spark):
    """Each of 3,000 roots has 20 dependents; the graph is not read anew for each of them."""
    e = spark.range(60_000).select(F.format_string("d%d", "id").alias("claim_id"), F.format_string("r%d", F.col("id") % 3000).alias("supports_id"), F.lit(0.9).alias("p_given"), F.lit(0.5).alias("p_given_not"), F.lit(1.0).alias("strength"), F.col("id").alias("from_us"), F.col("id").alias("seq"))
    c = e.select("claim_id").union(e.select("supports_id").distinct()).select("claim_id", F.lit(0.9).alias("score"), F.lit(0.05).alias("materiality"), F.lit(False).alias("critical"))
    roots = spark.range(3000).select(F.format_string("r%d", "id").alias("root"), F.lit(0.0).alias("score"))
    began = time.time()
    quality = getattr(revision, "quality", lambda c, e, r: revision.trigger_quality(graph.revisit(c, e, r), graph.revisit(c, e, r, cutoff=0.0)))
    got = {tuple(r)[1:] for r in quality(c, e, roots).collect()}
    assert got == {(20, 20, 1.0, 1.0, 20)} and time.time() - began < 60
