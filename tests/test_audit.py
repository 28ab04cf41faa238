"""Audits, governed stores, log files that were torn or tampered with."""

import json

import pytest
from pyspark.sql import functions as F

from beliefloom.functions import canonical as C
from beliefloom.operators import audit, chain, fold
from beliefloom.operators import write as W
from beliefloom.sources import logs
from tests.test_ledger import REC

T = "2024-01-01T00:00:00Z"
GENESIS = b"\7" * 32
SEEDS = {"root": GENESIS, "admin": b"\1" * 32, "ann": b"\2" * 32, "bob": b"\3" * 32}
PUB = {k: C.public_key(s).hex() for k, s in SEEDS.items()}


def chain_of(events, store="s"):
    """Records of (actor, type, payload, signer or None); a signer differs from the actor where a signature is forged."""
    out, prev = [], C.GENESIS
    for i, (actor, kind, payload, signer) in enumerate(events, 1):
        h = C.record_hash(i, T, actor, kind, payload, prev)
        out.append((store, i, T, actor, kind, json.dumps(payload), prev, h, C.sign(SEEDS[signer], bytes.fromhex(h)).hex() if signer else None))
        prev = h
    return out


def enroll(key, role, pub=None):
    return {"key_id": key, "pubkey": PUB[key] if pub is None else pub, "role": role}


def test_governed(spark):
    note = {"claim_id": "A", "outcome": True}
    rows = chain_of([
        ("root", "key_enrollment", enroll("admin", "admin"), "root"),  # 1
        ("admin", "key_enrollment", enroll("ann", "writer"), "admin"),  # 2
        ("ann", "outcome", note, "ann"),  # 3 fine
        ("ann", "key_enrollment", enroll("bob", "writer"), "ann"),  # 4 a writer may not enroll
        ("bob", "outcome", note, "bob"),  # 5 so bob is not enrolled
        ("admin", "outcome", note, "admin"),  # 6 an admin is no writer
        ("ann", "outcome", note, "bob"),  # 7 forged
        ("root", "outcome", note, "root"),  # 8 the genesis key may write
        ("ann", "outcome", note, None),  # 9 unsigned
        ("admin", "key_enrollment", enroll("ann", "writer"), "admin"),  # 10 is enrolled already
        ("admin", "key_revocation", {"key_id": "ann"}, "admin"),  # 11
        ("ann", "outcome", note, "ann"),  # 12 revoked
        ("admin", "key_revocation", {"key_id": "ann"}, "admin"),  # 13 nothing to revoke
        ("admin", "key_revocation", {"key_id": "root"}, "admin"),  # 14
        ("admin", "key_enrollment", enroll("ann", "king"), "admin"),  # 15 malformed
        ("admin", "key_enrollment", enroll("ann", "writer", "ab"), "admin"),  # 16 malformed
        ("admin", "key_enrollment", enroll("ann", "writer"), "admin"),  # 17 again
        ("ann", "outcome", note, "ann"),  # 18 fine
        ("admin", "key_revocation", {"key_id": "admin"}, "admin"),  # 19 its own
        ("admin", "key_enrollment", enroll("bob", "writer"), "admin"),  # 20 revoked by now
    ])
    lg = logs.clean_log(spark.createDataFrame(rows, REC))
    got = {(r.seq, r.problem) for r in audit.governed(lg, "root", PUB["root"]).collect()}
    assert got == {
        (4, "without-authority"), (5, "unenrolled-key"), (6, "not-a-writer"), (7, "invalid-signature"), (9, "unsigned"), (10, "already-enrolled"), (12, "revoked-key"),
        (13, "nothing-to-revoke"), (14, "genesis-revoked"), (15, "malformed"), (16, "malformed"), (20, "revoked-key"),
    }
    windows = {(r.key_id, r.enrolled_seq, r.revoked_seq) for r in audit.key_history(lg, "root", PUB["root"])[0].collect()}
    assert windows == {("admin", 1, 19), ("ann", 2, 11), ("ann", 17, None)}
    bad = [list(r) for r in rows]
    bad[2][2] = "2025-01-01T00:00:00Z"
    assert (3, "BadHash") in {(r.seq, r.problem) for r in audit.governed(logs.clean_log(spark.createDataFrame([tuple(r) for r in bad], REC)), "root", PUB["root"]).collect()}
    assert audit.governed(lg.limit(0), "root", PUB["root"]).count() == 0


def test_verdicts(spark):
    m1, m2 = W.verdict_message("escalate", "E1", "ann", "release"), W.verdict_message("resolve", "E2", "ann")
    said = lambda m, seed: {"signer": "ann", "signed_message": m.decode(), "signature": C.sign(seed, m).hex(), "claim_a": "a", "claim_b": "b"}
    events = [
        ("x", "contradiction", said(m1, SEEDS["ann"]), None),  # before the key: not valid
        ("x", "writer_registered", {"writer_id": "ann", "tier": "owner", "pubkey": PUB["ann"]}, None),
        ("x", "contradiction", said(m1, SEEDS["ann"]), None),
        ("x", "writer_registered", {"writer_id": "ann", "tier": "owner"}, None),  # the key stays
        ("x", "contradiction", said(m2, SEEDS["ann"]), None),
        ("x", "writer_registered", {"writer_id": "ann", "tier": "owner", "pubkey": PUB["bob"]}, None),
        ("x", "contradiction", said(m2, SEEDS["ann"]), None),  # the old key no more
        ("x", "contradiction", {"claim_a": "a", "claim_b": "b"}, None),
    ]
    lg = logs.clean_log(spark.createDataFrame(chain_of(events), REC))
    assert {(r.seq, r.valid) for r in audit.verdict_signatures(lg).collect()} == {(1, False), (3, True), (5, True), (7, False)}
    v = spark.createDataFrame([("s", 1, "ann", m1.decode(), None), ("s", 3, "ann", m1.decode(), None), ("s", 4, "ann", m1.decode(), C.sign(SEEDS["ann"], m1).hex()), ("s", 7, "ann", m1.decode(), C.sign(SEEDS["ann"], m1).hex()), ("s", 8, "zoe", m1.decode(), None)], "store string, seq long, writer string, message string, signature string")
    assert {r.seq: r.problem for r in audit.required_signature(v, lg).collect()} == {1: None, 3: "signature-required", 4: None, 7: "invalid", 8: None}


def test_consistent_heads():
    cp = [{"first_seq": 1 + 4 * i, "last_seq": 4 + 4 * i, "root": f"r{i}", "prev_root": f"r{i - 1}" if i else ""} for i in range(4)]
    head = lambda i: {"checkpoint_seq": i + 1, "tree_size": cp[i]["last_seq"], "root": cp[i]["root"]}
    assert audit.consistent(head(0), head(3), cp[1:]) and audit.consistent(head(2), head(2), [])
    assert not audit.consistent(head(0), head(3), cp[2:]) and not audit.consistent(head(3), head(0), []) and not audit.consistent(head(0), head(3) | {"root": "x"}, cp[1:])
    assert not audit.consistent(head(0) | {"root": "x"}, head(3), cp[1:]) and not audit.consistent(head(0), head(3), [cp[1], cp[3], cp[2]])
    assert not audit.consistent(head(1), head(1) | {"root": "x"}, [])


def test_log_files(spark, tmp_path):
    path = str(tmp_path / "events.log")
    assert logs.recover(path) == 0
    logs.append_chain(path, [(T, "a", "note", {"i": i, "s": "é" * i}) for i in range(5)])
    logs.append_chain(path, [(T, "a", "note", {"i": 5})])
    whole = open(path, "rb").read()
    rows, torn = logs.scan_chain(spark, path)
    assert (rows.count(), torn) == (6, 0) and logs.read_chain(spark, path).where("crc_ok").count() == 6
    assert logs.recover(path) == 0
    with open(path, "ab") as f:
        f.write(b"deadbeef {\"seq\": 7")
    rows, torn = logs.scan_chain(spark, path)
    assert (rows.count(), torn) == (6, 1)
    with pytest.raises(ValueError):
        logs.append_chain(path, [(T, "a", "note", {})])
    assert logs.recover(path) == len(b"deadbeef {\"seq\": 7") and open(path, "rb").read() == whole
    lines = whole.split(b"\n")
    for broken in (b"\n".join([lines[0], lines[1].replace(b"note", b"nota"), *lines[2:]]), b"\n".join([lines[0], *lines[2:]])):
        open(path, "wb").write(broken)
        with pytest.raises(ValueError):
            logs.scan_chain(spark, path)
    open(path, "wb").write(whole)
    logs.write_snapshot(path, str(tmp_path / "snap"), segment=2)
    back = str(tmp_path / "back.log")
    assert logs.restore_snapshot(str(tmp_path / "snap"), back)["events"] == 6 and open(back, "rb").read() == whole
    with pytest.raises(FileExistsError):
        logs.restore_snapshot(str(tmp_path / "snap"), back)
    (tmp_path / "snap" / "events.log").write_bytes(whole[:-3])
    with pytest.raises(ValueError):
        logs.restore_snapshot(str(tmp_path / "snap"), str(tmp_path / "other.log"))


def test_point_read_append_and_migration(spark, tmp_path):
    rows = chain_of([("a", "note", {"i": i}, None) for i in range(4)])
    df = spark.createDataFrame(rows, REC)
    folder = str(tmp_path / "table")
    assert logs.append_events(df.where("seq <= 2"), folder) == 2 and logs.append_events(df.where("seq > 2"), folder) == 2
    table = spark.read.parquet(folder)
    assert logs.record_at(table, "s", 3)["hash"] == rows[2][7] and logs.record_at(table, "s", 9) is None
    with pytest.raises(ValueError):
        logs.record_at(table.withColumn("t", F.lit("x")), "s", 3)
    source = tmp_path / "old.jsonl"
    events = [W.record_outcome(f"C{i}", True, t=T) for i in range(3)]
    source.write_text("\n\n".join(json.dumps(e) for e in events) + "\n")
    at = logs.migrate(spark, str(source), str(tmp_path / "new.log"))
    assert at == {e["event_id"]: i for i, e in enumerate(events, 2)}
    new, torn = logs.scan_chain(spark, str(tmp_path / "new.log"))
    assert torn == 0 and chain.chain_problems(new).count() == 0 and new.where("type = 'outcome'").count() == 3


def test_projection(spark, tmp_path):
    rows = chain_of([("a", "assert", {"claim_id": "A", "statement": "x", "prior": 0.5}, None), ("a", "score_revision", {"claim_id": "A", "old_score": 0.5, "new_score": 0.7}, None)])
    lg = logs.clean_log(spark.createDataFrame(rows, REC))
    folder = str(tmp_path / "p")
    assert fold.rebuild(lg, folder)["claims"] == 2
    claims = fold.read_projection(spark, folder, "claims")
    assert audit.store_problems(lg, {"claims": claims}).count() == 0
    assert [r.problem for r in audit.store_problems(lg, {"claims": claims.withColumn("score", F.col("score") + 1)}).collect()] == ["score-differs"]
    assert fold.rebuild(lg.where("seq = 1"), folder)["claims"] == 1 and fold.read_projection(spark, folder, "claims").count() == 1


def test_tenants(spark):
    ok = {"a": True, "0-x": True, "a" * 64: True, "a" * 65: False, "": False, "-a": False, "A": False, "a/b": False, "a.b": False, "a\n": False}
    df = spark.createDataFrame([(k,) for k in [*ok, None]], "s string")
    assert {r.s: r.ok for r in df.select("s", audit.slug_ok(F.col("s")).alias("ok")).collect()} == ok | {None: False}
    for k, v in ok.items():
        if v:
            assert audit.tenant_folder("/x/", k) == f"/x/{k}"
        else:
            with pytest.raises(ValueError):
                audit.tenant_folder("/x", k)


def test_interval_events_and_policies():
    one = W.combine_interval("A", (0.4, 0.8), 0.5, 0.1, 0.4, t=T)
    k = 0.4 * 0.1 + 0.2 * 0.5
    assert [e["type"] for e in one] == ["interval_set", "interval_combined"] and abs(one[1]["payload"]["belief"] - (0.4 * 0.9 + 0.4 * 0.5) / (1 - k)) < 1e-12
    assert [e["type"] for e in W.combine_interval("A", (1.0, 1.0), 0.0, 1.0, 0.0, t=T)] == ["interval_refused"]
    with pytest.raises(KeyError):
        W.combine_interval("A", None, 1, 0, 0)
    with pytest.raises(ValueError):
        W.combine_interval("A", (0, 1), 1, 1, 0)
    live = {"version": 2, "description": "d"}
    assert W.ensure_policy(live, "p", 2, "d") is None and W.ensure_policy(live, "p", 3, "e", t=T)["payload"]["version"] == 3 and W.ensure_policy(None, "p", 1, "d", t=T)
    with pytest.raises(ValueError):
        W.ensure_policy(live, "p", 2, "other")
    assert W.apply_tier({"claim_id": "A", "entrenchment": 0.5}, "measured", t=T)["payload"]["new"] == 0.75
