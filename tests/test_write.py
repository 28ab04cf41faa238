import pytest
from pyspark.sql import functions as F

from beliefloom.functions import canonical as C
from beliefloom.operators import chain, consolidate, fold, render
from beliefloom.operators import write as W
from beliefloom.sources import logs
from tests.test_ledger import REC, records

T = "2024-01-01T00:00:00Z"


def test_events_are_checked():
    for bad in (
        lambda: W.assert_claim("A", "s", 1.5), lambda: W.assert_claim("", "s", 0.5), lambda: W.assert_claim("A", "s", 0.5, entrenchment="firm"), lambda: W.add_support("A", "A", "deductive", 1, 0),
        lambda: W.add_support("A", "B", "vague", 1, 0), lambda: W.set_status("A", "superseded", reason="r", source="s"), lambda: W.set_status("A", "dead", reason=" ", source="s"),
        lambda: W.set_interval("A", 0.9, 0.1), lambda: W.record_decision("D", "x", []), lambda: W.set_combo("A", "xor", 0, {}), lambda: W.register_writer("w", "king"),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(PermissionError):
        W.escalate({"event_id": "E", "claim_a": "a", "claim_b": "b"}, True, "ann", "provisional")
    a, b = W.supersede({"claim_id": "A", "entrenchment": 0.75, "materiality": 0.2, "critical": True}, "B", "better", 0.4, reason="r", source="s", t=T)
    assert (a["type"], b["type"], a["t"], b["t"]) == ("assert", "supersede", T, T) and a["payload"]["entrenchment"] == 0.75 and "writer" not in a["payload"]
    assert W.assert_claim("A", "s", 0.5, t=T)["event_id"] == W.assert_claim("A", "s", 0.5, t=T)["event_id"]
    assert [W.declare_contradiction("a", "b", e, t=T)["type"] for e in ("allow", "hold", "deny")] == ["contradiction", "contradiction_held", "policy_denied"]
    seed = b"\1" * 32
    m = W.verdict_message("escalate", "E1", "ann", "dismiss")
    s = W.signed(W.escalate({"event_id": "E1", "claim_a": "a", "claim_b": "b"}, False, "ann", "owner", t=T), seed, "ann", m)
    assert C.verify(C.public_key(seed), s["payload"]["signed_message"].encode(), bytes.fromhex(s["payload"]["signature"]))
    assert [x[2] for x in W.migrate([W.record_outcome("A", True, t=T)], "head")] == ["migration", "outcome"]
    assert W.as_row(W.record_outcome("A", True, t=T), "s", 3)[:2] == ("s", 3)


def log_of(spark, events):
    return logs.clean_log(spark.createDataFrame(records(spark, [(e["actor"], e["type"], e["payload"]) for e in events]), REC))


def test_registers_and_combos(spark):
    ev = [
        W.register_writer("w", "provisional", "k1"), W.register_writer("w", "owner"), W.register_graph("g", 0.5), W.assign_topic("A", "x"), W.assign_topic("A", "y"),
        W.add_support("A", "B", "deductive", 0.9, 0.1), W.add_support("A", "C", "deductive", 0.9, 0.1), W.set_combo("A", "noisy-and", 0.1, {"B": 0.5}), W.set_combo("A", "noisy-or", 0.2, {"B": 0.25}),
        W.set_interval("A", 0.2, 0.8),
    ]
    log = log_of(spark, ev)
    assert {(r.tier, r.pubkey, r.txn_to is None) for r in fold.register(log, "writers").collect()} == {("provisional", "k1", False), ("owner", "k1", True)}
    assert {(r.topic, r.txn_to is None) for r in fold.register(log, "claim_topics").collect()} == {("x", False), ("y", True)}
    for name in fold.REGISTERS:
        fold.register(log, name).collect()
    assert {(r.combo, r.txn_to is None) for r in fold.combos(log).collect()} == {("noisy-and", False), ("noisy-or", True)}
    e = {r.supports_id: r.strength for r in fold.with_strengths(fold.support_edges(log), log).collect()}
    assert e == {"B": 0.25, "C": 1.0}


def test_consolidation(spark):
    replies = spark.createDataFrame([('sure: {"same": [["a", "b"], ["a", "a"], ["x"]], "supports": [["b", "c"]]} done',), ("none",), (None,)], "reply string")
    p = consolidate.parse_relations(replies, "reply")
    assert {tuple(r) for r in p.collect()} == {("same", "a", "b"), ("supports", "b", "c")}
    claims = spark.createDataFrame([("b", 0.5, "B"), ("a", 0.25, "A")], "claim_id string, score double, statement string")
    assert {tuple(r) for r in consolidate.known_pairs(p, claims).collect()} == {("b", "a", "same")}
    assert consolidate.prompt(claims).first().prompt.endswith("[a] (credence 0.25) A\n[b] (credence 0.50) B")
    assert claims.select(consolidate.topic(F.min("claim_id"))).first()[0] == "prop:a"


def test_rendering_and_gate(spark, tmp_path):
    log = log_of(spark, [W.assert_claim("A", "a | b\nc", 0.5), W.assert_claim("B", "b", 0.9), W.set_status("B", "dead", reason="r", source="s"), W.record_decision("D", "go", ["A"])])
    rows = render.matrix_rows(log)
    text = {"matrix.json": render.matrix_json(rows), "matrix.md": render.matrix_markdown(rows), "map.json": render.map_json(log)}
    assert '"dead": 1' in text["matrix.json"] and "a \\| b c" in text["matrix.md"] and '"label": "go"' in text["map.json"]
    assert render.gate(text, str(tmp_path)) == list(text)
    for n, x in text.items():
        (tmp_path / n).write_bytes(x.encode())
    assert render.gate(text, str(tmp_path)) == []
    (tmp_path / "matrix.md").write_text("x")
    assert render.gate(text, str(tmp_path)) == ["matrix.md"]


def test_anchored_record():
    seed = b"\2" * 32
    pub = C.public_key(seed)
    hashes = [C.record_hash(i, T, "a", "note", {"i": i}, C.GENESIS) for i in range(1, 9)]
    cp = logs.checkpoints(hashes, 4)
    head = chain.sign_head(cp[1], 1, T, "k", seed)
    proof = [p.hex() for p in C.inclusion_proof([bytes.fromhex(h) for h in hashes[4:]], 2)]
    assert chain.anchored(hashes[6], 7, proof, cp[1], head, pub)
    assert not chain.anchored(hashes[5], 7, proof, cp[1], head, pub) and not chain.anchored(hashes[6], 3, proof, cp[1], head, pub)
    assert not chain.anchored(hashes[6], 7, proof, cp[1], head | {"timestamp": "x"}, pub)


def test_consolidation_pass(spark):
    claims = spark.createDataFrame([(c, f"says {c}", 0.5, "prop:x" if c == "a" else None) for c in "abcde"], "claim_id string, statement string, score double, topic string")
    reply = '{"same": [["a", "b"], ["b", "c"], ["d", "gone"]], "contradicts": [["e", "a"], ["b", "e"]], "supports": [["d", "e"]]}'
    known = spark.createDataFrame([("e", "b")], "claim_a string, claim_b string")
    got = consolidate.consolidation_pass(spark.createDataFrame([(reply,)], "reply string"), "reply", claims, known, T).collect()
    assert {(r.type, r.payload) for r in got} == {
        ("topic_assigned", '{"claim_id":"b","topic":"prop:a"}'), ("topic_assigned", '{"claim_id":"c","topic":"prop:a"}'),
        ("contradiction", '{"claim_a":"a","claim_b":"e","p_loser_given_winner":0.1}'), ("support_proposed", '{"supports_id":"d","claim_id":"e"}')}
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "e"), ("a", "a")], "claim_a string, claim_b string")
    text = "".join(r.prompt for r in consolidate.pair_prompts(claims, pairs, block=1).collect())
    assert text.count("says a\n[b]") == 1 and text.count("says c\n[e]") == 1
    assert consolidate.same_groups(pairs.limit(0)).count() == 0


def test_matrix_is_validated(spark):
    good = render.matrix_json([{"claim_id": "A", "statement": "x", "confidence": 0.5, "status": "active", "superseded_by": None}])
    assert render.validate_matrix(good) == []
    for bad in ("{", "[]", good.replace("0.5", "1.5"), good.replace('"active"', '"superseded"'), good.replace('"active": 1', '"active": 2'), good.replace('"statement"', '"text"')):
        assert render.validate_matrix(bad)


def test_story(spark):
    from beliefloom.plans import demo

    got = {r.claim_id: (r.new, r.flagged, r.decision_id) for r in demo.story(spark).collect()}
    assert got == {"wheel": (0.05, True, None), "mill": (0.045, True, "order flour"), "bread": (round(0.045 * 0.95, 6), True, None)}
