"""Integrity of chained logs, checked in parallel: hashes, linkage, Merkle checkpoints, proofs, signatures."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beliefloom.functions import canonical as C

SEGMENT = 1024


def _rehash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("seq", "t", "actor", "type", "payload", "prev_hash", "hash")]
        ok = []
        for seq, t, actor, kind, payload, prev, h in zip(*cols):
            try:
                ok.append(C.record_hash(seq, t, actor, kind, json.loads(payload), prev) == h)
            except (ValueError, TypeError, AttributeError):
                ok.append(False)
        yield b.select(["store", "seq", "prev_hash", "hash"]).append_column("hash_ok", pa.array(ok))


def rehashed(log: DataFrame) -> DataFrame:
    """store, seq, prev_hash, hash, hash_ok: whether each record's hash is that of its canonical content; row-local."""
    return log.select("store", "seq", "prev_hash", "hash", "t", "actor", "type", "payload").mapInArrow(_rehash, "store string, seq long, prev_hash string, hash string, hash_ok boolean")


def chain_problems(log: DataFrame) -> DataFrame:
    """store, seq, problem: ``BadSequence`` (the record before is missing), ``BadPrevHash``, ``BadHash``; the first that applies.

    The record before is found by an equi-join on (store, seq - 1), never by a window over a whole store.
    """
    r = rehashed(log)
    prev = log.select("store", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    j = r.join(prev, ["store", "seq"], "left")
    expected = F.when(F.col("seq") == 1, F.lit(C.GENESIS)).otherwise(F.col("before"))
    problem = F.when(expected.isNull(), "BadSequence").when(F.col("prev_hash") != expected, "BadPrevHash").when(~F.col("hash_ok"), "BadHash")
    return j.select("store", "seq", problem.alias("problem")).where("problem IS NOT NULL")


def heads(log: DataFrame) -> DataFrame:
    """store, n, head_seq, head_hash."""
    return log.groupBy("store").agg(F.count("*").alias("n"), F.max("seq").alias("head_seq"), F.max_by("hash", "seq").alias("head_hash"))


def segments(log: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """store, no, first_seq, last_seq, root: the Merkle root of each full segment; a segment is one bounded group."""

    def root(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("seq").to_pylist(), t.column("hash").to_pylist()))
        value = C.merkle_root([bytes.fromhex(h) for _, h in rows]).hex()
        return pa.table({"store": pa.array([t.column("store")[0].as_py()]), "no": pa.array([t.column("no")[0].as_py()], pa.int64()), "first_seq": pa.array([rows[0][0]], pa.int64()), "last_seq": pa.array([rows[-1][0]], pa.int64()), "n": pa.array([len(rows)], pa.int64()), "root": pa.array([value])})

    s = log.select("store", F.floor((F.col("seq") - 1) / segment).alias("no"), "seq", "hash")
    out = s.groupBy("store", "no").applyInArrow(root, "store string, no long, first_seq long, last_seq long, n long, root string")
    return out.where(F.col("n") == segment).drop("n")


def checkpoints(log: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """segments with prev_root: each checkpoint names the root before it, the first that of the empty tree."""
    s = segments(log, segment)
    prev = s.select("store", (F.col("no") + 1).alias("no"), F.col("root").alias("before"))
    return s.join(prev, ["store", "no"], "left").select("store", "no", "first_seq", "last_seq", "root", F.coalesce("before", F.lit(C.merkle_root([]).hex())).alias("prev_root"))


def link_problems(cp: DataFrame) -> DataFrame:
    """Checkpoints that do not follow on the one before, by seq or by root."""
    w = Window.partitionBy("store").orderBy("no")
    j = cp.select("store", "no", (F.lag("last_seq").over(w) + 1).alias("want"), "first_seq", F.lag("root").over(w).alias("before"), "prev_root")
    return j.where((F.coalesce("want", F.lit(1)) != F.col("first_seq")) | (F.coalesce("before", F.lit(C.merkle_root([]).hex())) != F.col("prev_root"))).select("store", "no")


def forks(heads_: DataFrame) -> DataFrame:
    """checkpoint_seq, tree_size of signed heads that name different roots."""
    return heads_.groupBy("store", "checkpoint_seq", "tree_size").agg(F.countDistinct("root").alias("roots")).where("roots > 1")


def inclusion(log: DataFrame, wanted: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """store, seq, proof (hex), root for wanted (store, seq) in full segments; one bounded group per segment concerned."""
    want = wanted.select(F.col("store").alias("in"), F.col("seq").alias("want"), F.floor((F.col("seq") - 1) / segment).alias("part"))

    def prove(hashes: pa.Table, want: pa.Table) -> pa.Table:
        rows = sorted(zip(hashes.column("seq").to_pylist(), hashes.column("hash").to_pylist()))
        out: list[tuple] = []
        if len(rows) == segment:
            leaves = [bytes.fromhex(h) for _, h in rows]
            proofs, root = C.inclusion_proofs(leaves)
            out = [(s, [x.hex() for x in proofs[s - rows[0][0]]], root.hex()) for s in want.column("want").to_pylist()]
        store = hashes.column("store")[0].as_py() if len(hashes) else None
        return pa.table({"store": pa.array([store] * len(out), pa.string()), "seq": pa.array([x[0] for x in out], pa.int64()), "proof": pa.array([x[1] for x in out], pa.list_(pa.string())), "root": pa.array([x[2] for x in out], pa.string())})

    near = log.select("store", F.floor((F.col("seq") - 1) / segment).alias("no"), "seq", "hash")
    near = near.join(want.select(F.col("in").alias("store"), F.col("part").alias("no")).distinct(), ["store", "no"])
    return near.groupBy("store", "no").cogroup(want.groupBy("in", "part")).applyInArrow(prove, "store string, seq long, proof array<string>, root string")


def signatures(log: DataFrame, keys: DataFrame) -> DataFrame:
    """store, seq, valid for signed records whose actor has a key in force (see governance.effective_at)."""
    from beliefloom.operators.audit import signed
    from beliefloom.operators.governance import effective_at

    rec = effective_at(keys, log.where("sig IS NOT NULL").select("store", "actor", "seq", "hash", "sig"))
    return signed(rec.select("store", "seq", "pubkey", F.unhex("hash").alias("message"), "sig"))


def append_table(log: DataFrame, events: list[tuple[str, str, str, object]], store: str) -> list[dict]:
    """The next records of one store for (t, actor, type, payload) events; the caller writes them."""
    last = log.where(F.col("store") == store).agg(F.max("seq").alias("s"), F.max_by("hash", "seq").alias("h")).first()
    seq, prev, out = last["s"] or 0, last["h"] or C.GENESIS, []
    for t, actor, kind, payload in events:
        seq += 1
        h = C.record_hash(seq, t, actor, kind, payload, prev)
        out.append({"store": store, "seq": seq, "t": t, "actor": actor, "type": kind, "payload": C.canonical(payload), "prev_hash": prev, "hash": h})
        prev = h
    return out


def sign_head(checkpoint: dict, no: int, timestamp: str, key_id: str, seed: bytes) -> dict:
    """A signed tree head of a checkpoint (a row of ``checkpoints`` as a dict)."""
    digest = C.head_digest(checkpoint["last_seq"], checkpoint["root"], no, timestamp, key_id)
    return {"tree_size": checkpoint["last_seq"], "root": checkpoint["root"], "checkpoint_seq": no, "timestamp": timestamp, "key_id": key_id, "signature": C.sign(seed, digest).hex()}


def verify_head(head: dict, pubkey: bytes) -> bool:
    digest = C.head_digest(head["tree_size"], head["root"], head["checkpoint_seq"], head["timestamp"], head["key_id"])
    return C.verify(pubkey, digest, bytes.fromhex(head["signature"]))


def anchored(record_hash: str, seq: int, proof: list[str], checkpoint: dict, head: dict, pubkey: bytes) -> bool:
    """Is a record part of the checkpoint that a validly signed head names?"""
    if not verify_head(head, pubkey) or head["root"] != checkpoint["root"] or head["tree_size"] != checkpoint["last_seq"]:
        return False
    if not checkpoint["first_seq"] <= seq <= checkpoint["last_seq"]:
        return False
    size = checkpoint["last_seq"] - checkpoint["first_seq"] + 1
    return C.verify_inclusion(bytes.fromhex(record_hash), seq - checkpoint["first_seq"], size, [bytes.fromhex(p) for p in proof], bytes.fromhex(checkpoint["root"]))
