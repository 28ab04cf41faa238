"""Reading and writing event logs: record tables, JSON lines, chained lines, snapshots."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from beliefloom.functions import canonical as C
from beliefloom.functions.text import instant_us
from beliefloom.session import _delete, cut

#: All payload fields that any event type has; absent ones parse as null.
PAYLOAD = (
    "claim_id string, statement string, prior double, writer string, valid_from string, valid_to string, score_kind string, status string, "
    "materiality double, critical boolean, entrenchment double, source string, falsifier string, does_not_establish string, old_score double, "
    "new_score double, triggering_event_id string, old double, new double, old_claim_id string, new_claim_id string, reason string, "
    "supports_id string, kind string, p_given double, p_given_not double, strength double, combo string, leak double, strengths map<string,double>, "
    "writer_id string, tier string, pubkey string, name string, version int, description string, graph string, ceiling double, topic string, "
    "belief double, plausibility double, outcome boolean, decision_id string, label string, basis array<string>, key_id string, role string, "
    "claim_a string, claim_b string, p_loser_given_winner double, contradiction_id string, held_id string, fact_id string, n_flags int, derived_from string, "
    "signer string, signature string, signed_message string, loser string, winner string"
)
STATE_EVENTS = (
    "assert", "score_revision", "entrenchment_set", "supersede", "claim_status_changed", "support", "retract_support", "combo_set",
    "writer_registered", "policy_registered", "graph_registered", "graph_assigned", "topic_assigned", "interval_set", "outcome",
)
RECORD_EVENTS = (
    "revisit", "policy_denied", "interval_refused", "interval_combined", "contradiction", "contradiction_held", "contradiction_dismissed",
    "contradiction_resolved", "contradiction_unresolved", "contract", "decision", "key_enrollment", "key_revocation", "commitment", "erasure", "migration",
)


def clean_log(records: DataFrame) -> DataFrame:
    """One intact record per (store, seq), with the payload parsed as ``p``.

    Rows delivered again or written anew (other key order or escapes) are one record; torn payloads do not count.
    """
    r = records.where(F.try_parse_json("payload").isNotNull() & F.col("store").isNotNull() & F.col("seq").isNotNull())
    one = F.min(F.struct("payload", "t", "actor", "type", "prev_hash", "hash", "sig")).alias("r")
    r = r.groupBy("store", "seq").agg(one).select("store", "seq", "r.*")
    return r.withColumn("t_us", instant_us(F.col("t"))).withColumn("p", F.from_json("payload", PAYLOAD))


def unknown_types(log: DataFrame) -> DataFrame:
    """Records of a type that no fold knows; a non-empty result is an error for the caller to raise."""
    return log.where(~F.col("type").isin(*STATE_EVENTS, *RECORD_EVENTS))


def read_jsonl(spark: SparkSession, path: str, store: str = "main") -> DataFrame:
    """An imported log of one JSON object per line; seq is the line's number among non-blank lines.

    Raises if a line does not parse.
    """
    lines = spark.sparkContext.textFile(path).filter(lambda x: bool(x.strip())).zipWithIndex()
    raw = spark.createDataFrame(lines, "line string, seq long").withColumn("seq", F.col("seq") + 1)
    event = F.from_json("line", "event_id string, t string, actor string, type string, payload string")
    df = raw.select(F.lit(store).alias("store"), "seq", event.alias("e"), "line")
    df = df.withColumn("ok", F.when(F.try_parse_json("line").isNull(), F.raise_error(F.concat(F.lit("line does not parse: "), F.col("seq").cast("string")))).otherwise(F.lit(True)))
    df = df.where("ok").select("store", "seq", "e.*")
    return df.withColumn("t_us", instant_us(F.col("t"))).withColumn("p", F.from_json("payload", PAYLOAD))


def chain_line(record: dict) -> str:
    """``<crc> <json>`` of a record, without the newline."""
    doc = {k: record[k] for k in ("seq", "t", "actor", "type", "payload", "prev_hash", "hash", "sig") if record.get(k) is not None}
    body = json.dumps(doc, separators=(",", ":"), ensure_ascii=False)
    return f"{C.crc32c(body.encode())} {body}"


def _last_line(path: Path) -> tuple[int, bytes]:
    """(offset, bytes) of what follows the last line break but one of a file, read from its end."""
    with path.open("rb") as f:
        at = end = f.seek(0, 2)
        tail = b""
        while at > 0 and b"\n" not in tail.rstrip(b"\n"):
            at = max(0, at - 65536)
            f.seek(at)
            tail = f.read(end - at)
    body = tail.rstrip(b"\n")
    cut = body.rfind(b"\n") + 1
    return at + cut, tail[cut:]


def _sound(line: bytes) -> dict | None:
    """The record of a chained line, if its checksum is right."""
    try:
        crc, body = line.rstrip(b"\n").decode().split(" ", 1)
        return json.loads(body) if C.crc32c(body.encode()) == crc else None
    except ValueError:
        return None


def recover(path: str) -> int:
    """Cuts a torn last line off a chained log file (what a crash while appending leaves); returns the bytes cut off.

    Only the end of the file is read.  Bad lines before the last are not repaired: scan_chain() refuses them.
    """
    at = Path(path)
    if not at.exists() or not at.stat().st_size:
        return 0
    offset, line = _last_line(at)
    if _sound(line) is not None and line.endswith(b"\n"):
        return 0
    size = at.stat().st_size
    with at.open("rb+") as f:
        f.truncate(offset)
        os.fsync(f.fileno())
    return size - offset


def append_chain(path: str, events: Iterable[tuple[str, str, str, object]], seed: bytes | None = None) -> list[dict]:
    """Appends (t, actor, type, payload) events to a chained log file; each hash depends on the one before.

    Of the file only the last line is read; a torn one must be recovered first.
    """
    at = Path(path)
    last = {"seq": 0, "hash": C.GENESIS}
    if at.exists() and at.stat().st_size:
        last = _sound(_last_line(at)[1])
        if last is None:
            raise ValueError(f"the last line of {path} is torn")
    out = []
    with at.open("a", encoding="utf-8") as f:
        for t, actor, kind, payload in events:
            seq, prev = last["seq"] + 1, last["hash"]
            last = {"seq": seq, "t": t, "actor": actor, "type": kind, "payload": payload, "prev_hash": prev, "hash": C.record_hash(seq, t, actor, kind, payload, prev)}
            if seed is not None:
                last["sig"] = C.sign(seed, bytes.fromhex(last["hash"])).hex()
            f.write(chain_line(last) + "\n")
            out.append(last)
        f.flush()
        os.fsync(f.fileno())
    return out


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (crc, body, others): crc_ok instead of crc; all lines of a batch step through their bytes together."""
    for b in batches:
        body = b.column("body").cast(pa.binary())
        off = np.asarray(pa.Array.from_buffers(pa.int32(), len(body) + 1, [None, body.buffers()[1]], offset=body.offset)).astype(np.int64) if len(body) else np.zeros(1, np.int64)
        flat = np.frombuffer(body.buffers()[2], np.uint8) if len(body) and body.buffers()[2] else np.zeros(0, np.uint8)
        table, size = np.array(C._CRC, np.uint32), np.diff(off)
        order = np.argsort(-size, kind="stable")
        crc, many = np.full(len(body), 0xFFFFFFFF, np.uint32), size[order]
        for k in range(int(many[0]) if len(many) else 0):
            live = order[: np.searchsorted(-many, -k, side="left")]
            crc[live] = table[(crc[live] ^ flat[off[live] + k]) & 255] ^ (crc[live] >> 8)
        want = [f"{x:08x}" for x in crc ^ np.uint32(0xFFFFFFFF)]
        ok = [a == c for a, c in zip(want, b.column("crc").to_pylist())]
        keep = [n for n in b.schema.names if n != "crc"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(ok, pa.bool_())], names=[*keep, "crc_ok"])


def read_chain(spark: SparkSession, path: str, store: str = "main") -> DataFrame:
    """Chained log files as records: store, seq, t, actor, type, payload (JSON text), prev_hash, hash, sig, crc_ok."""
    raw = spark.read.text(path).where(F.length("value") > 0)
    raw = raw.select(F.substring("value", 1, 8).alias("crc"), F.substring("value", 10, 1 << 30).alias("body"))
    e = F.from_json("body", "seq long, t string, actor string, type string, payload string, prev_hash string, hash string, sig string")
    good = raw.mapInArrow(_checksums, "body string, crc_ok boolean")
    return good.select(F.lit(store).alias("store"), e.alias("e"), "crc_ok").select("store", "e.*", "crc_ok")


def scan_chain(spark: SparkSession, path: str, store: str = "main") -> tuple[DataFrame, int]:
    """(records, torn): a chained log file with its torn last line, if it has one, left out; an error if a line before is bad."""
    lines = spark.sparkContext.textFile(path).zipWithIndex()
    raw = spark.createDataFrame(lines, "value string, line long").where(F.length("value") > 0)
    raw = raw.select("line", F.substring("value", 1, 8).alias("crc"), F.substring("value", 10, 1 << 30).alias("body"))
    e = F.from_json("body", "seq long, t string, actor string, type string, payload string, prev_hash string, hash string, sig string")
    rows = cut(raw.mapInArrow(_checksums, "line long, body string, crc_ok boolean").withColumn("e", e))
    bad = ~F.col("crc_ok") | F.col("e.seq").isNull()
    at = rows.agg(F.max("line").alias("last"), F.min(F.when(bad, F.col("line"))).alias("bad"), F.count_if(bad).alias("n")).first()
    if at["n"] > 1 or (at["n"] and at["bad"] != at["last"]):
        raise ValueError(f"line {at['bad'] + 1} of {path} is bad")
    good = rows.where(~bad).select("line", "e.seq", "e.hash", "e.prev_hash")
    before = good.select((F.col("line") + 1).alias("line"), (F.col("seq") + 1).alias("want"), F.col("hash").alias("before"))
    linked = good.join(before, "line", "left").where((F.coalesce("want", F.lit(1)) != F.col("seq")) | (F.coalesce("before", F.lit(C.GENESIS)) != F.col("prev_hash")))
    broken = linked.agg(F.min("line")).first()[0]
    if broken is not None:
        raise ValueError(f"line {broken + 1} of {path} does not follow on the one before")
    return rows.where(~bad).select(F.lit(store).alias("store"), "e.*", F.lit(True).alias("crc_ok")), at["n"]


def record_at(log: DataFrame, store: str, seq: int) -> dict | None:
    """One record by its seq, its hash computed anew; None if there is none, an error if the hash is wrong.

    On a table the filter reaches the scan, which skips by the statistics of store and seq.
    """
    rows = log.where((F.col("store") == store) & (F.col("seq") == seq)).select("store", "seq", "t", "actor", "type", "payload", "prev_hash", "hash").limit(64).collect()
    if not rows:
        return None
    for r in rows:
        try:
            if C.record_hash(r["seq"], r["t"], r["actor"], r["type"], json.loads(r["payload"]), r["prev_hash"]) == r["hash"]:
                return r.asDict()
        except ValueError:
            continue
    raise ValueError(f"record {seq} of {store} does not have its hash")


def append_events(events: DataFrame, folder: str) -> int:
    """Appends rows (store, seq, t, actor, type, payload, ...) to a table of records and reads them back; returns their number.

    The rows are one batch, a folder below ``batch=``; if what is read back differs from what was sent, the batch is
    removed and an error raised.
    """
    spark = events.sparkSession
    name = f"{folder}/batch={uuid.uuid4().hex}"
    sent = Observation()
    digest = F.bit_xor(F.xxhash64(*events.columns))
    events.observe(sent, F.count(F.lit(1)).alias("n"), digest.alias("h")).write.parquet(name)
    back = spark.read.schema(events.schema).parquet(name).agg(F.count(F.lit(1)).alias("n"), digest.alias("h")).first()
    if (back["n"], back["h"]) != (sent.get["n"], sent.get["h"]):
        _delete(spark, name)
        raise OSError(f"{name} reads back other rows than were written")
    return back["n"]


def write_verified(path: str, data: bytes) -> None:
    """A small file, whole or not at all: written beside its place, flushed, read back, then renamed."""
    to = Path(path)
    beside = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
    try:
        with beside.open("wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if beside.read_bytes() != data:
            raise OSError(f"{path} reads back other bytes than were written")
        beside.replace(to)
    finally:
        beside.unlink(missing_ok=True)


def restore_snapshot(folder: str, log_path: str) -> dict:
    """Brings the log of an intact bundle back to a path that does not exist yet; returns the manifest."""
    problems = verify_snapshot(folder)
    if problems:
        raise ValueError("; ".join(problems))
    if Path(log_path).exists():
        raise FileExistsError(log_path)
    write_verified(log_path, (Path(folder) / "events.log").read_bytes())
    return json.loads((Path(folder) / "manifest.json").read_text())


def migrate(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """A log of JSON lines as a new chained log file; returns the seq that each event id has there.

    A marker with the hash of the source comes first.  The hashes make this a chain of steps, one for each event.
    """
    if Path(target).exists():
        raise FileExistsError(target)
    rows = read_jsonl(spark, source).select("event_id", "seq", "t", "actor", "type", "payload").orderBy("seq").toLocalIterator()
    raw = hashlib.sha256(Path(source).read_bytes()).hexdigest()
    at: dict[str, int] = {}

    def steps() -> Iterator[tuple[str, str, str, object]]:
        yield "1970-01-01T00:00:00Z", "system", "migration", {"source_sha256": raw}
        for n, r in enumerate(rows, 2):
            if r["event_id"] is not None:
                at[r["event_id"]] = n
            yield r["t"], r["actor"] or "system", r["type"], json.loads(r["payload"])

    append_chain(target, steps())
    return at


def checkpoints(hashes: list[str], segment: int = 1024) -> list[dict]:
    """Merkle checkpoints of full segments of a short chain, on the driver (see operators.chain for tables)."""
    out, prev = [], C.merkle_root([]).hex()
    for lo in range(0, len(hashes) // segment * segment, segment):
        root = C.merkle_root([bytes.fromhex(h) for h in hashes[lo : lo + segment]]).hex()
        out.append({"first_seq": lo + 1, "last_seq": lo + segment, "root": root, "prev_root": prev})
        prev = root
    return out


def write_snapshot(log_path: str, folder: str, segment: int = 1024, kind: str = "ledger-snapshot") -> dict:
    """A bundle of the log file, byte for byte, and a manifest with its hashes."""
    raw = Path(log_path).read_bytes()
    hashes = [json.loads(x.split(" ", 1)[1])["hash"] for x in raw.decode().splitlines()]
    manifest = {
        "format": 1, "kind": kind, "events": len(hashes), "head_hash": hashes[-1] if hashes else C.GENESIS, "segment": segment,
        "checkpoints": checkpoints(hashes, segment), "log_sha256": hashlib.sha256(raw).hexdigest(), "bundle_hash": "",
    }
    manifest["bundle_hash"] = _bundle(manifest)
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=False)
    (to / "events.log").write_bytes(raw)
    (to / "manifest.json").write_text(json.dumps(manifest, indent=2))
    return manifest


def _bundle(manifest: dict) -> str:
    text = manifest["log_sha256"] + "\n" + C.canonical(manifest | {"bundle_hash": ""})
    return hashlib.sha256(text.encode()).hexdigest()


def verify_snapshot(folder: str) -> list[str]:
    """Problems of a bundle; empty if it is intact."""
    at = Path(folder)
    manifest = json.loads((at / "manifest.json").read_text())
    raw = (at / "events.log").read_bytes()
    out = []
    if hashlib.sha256(raw).hexdigest() != manifest["log_sha256"]:
        out.append("log bytes differ")
    if _bundle(manifest) != manifest["bundle_hash"]:
        out.append("manifest differs")
    hashes = [json.loads(x.split(" ", 1)[1])["hash"] for x in raw.decode(errors="replace").splitlines() if " " in x]
    if checkpoints(hashes, manifest["segment"]) != manifest["checkpoints"]:
        out.append("checkpoints differ")
    return out
