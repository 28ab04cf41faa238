"""Audits: a store's projection against its log, signed verdicts, governed stores, health."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefloom.functions import canonical as C
from beliefloom.operators import chain, fold

#: Fields that every record has; roles of keys; largest difference of a score that is no fault.
FIELDS = ("t", "type", "payload")
ROLES = ("writer", "checkpoint", "admin")
SAME = 1e-9
#: Tables of a projection and the columns of theirs that name claims.
NAMES = {
    "claims": ("claim_id",), "support_edges": ("claim_id", "supports_id"), "outcomes": ("claim_id",), "claim_intervals": ("claim_id",),
    "combos": ("claim_id",), "claim_graphs": ("claim_id",), "claim_topics": ("claim_id",),
}


def record_problems(records: DataFrame, ident: str | None = None) -> DataFrame:
    """``store, seq, problem`` of raw records: an unparseable payload, a missing field, an id that another seq has too.

    Rows of one seq are deliveries of one record and count once; a payload is bad if no delivery of it parses.
    """
    good = F.try_parse_json("payload").isNotNull()
    r = records.where("store IS NOT NULL AND seq IS NOT NULL").groupBy("store", "seq").agg(F.max(good.cast("int")).alias("good"), *(F.max(c).alias(c) for c in FIELDS), *([F.max(ident).alias("id")] if ident else []))
    missing = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in FIELDS)), lambda x: x.isNotNull())
    out = r.select("store", "seq", F.explode(F.transform(missing, lambda x: F.concat(F.lit("missing "), x))).alias("problem"))
    out = out.unionByName(r.where("good = 0 AND payload IS NOT NULL").select("store", "seq", F.lit("unparseable payload").alias("problem")))
    if ident:
        first = r.where("id IS NOT NULL").groupBy("store", "id").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1")
        again = r.join(first, ["store", "id"]).where("seq > first")
        out = out.unionByName(again.select("store", "seq", F.concat(F.lit("duplicate id "), "id").alias("problem")))
    return out


def store_problems(log: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``store, claim_id, problem`` where a projection and its log disagree, in either direction.

    tables: those of a projection by name (see NAMES; missing ones are not checked), ``claims`` with txn_to and score.
    A claim whose last structural event is an assert must be live with the last score the log gives it; one that was
    ended must not be live; every claim that a table names must have been asserted.
    """
    key = F.when(F.col("type") == "supersede", F.col("p.old_claim_id")).otherwise(F.col("p.claim_id"))
    e = log.where(F.col("type").isin("assert", "score_revision", "supersede", "claim_status_changed")).select("store", key.alias("claim_id"), "seq", "type", F.coalesce("p.prior", "p.new_score").alias("score")).where("claim_id IS NOT NULL")
    structural, scored = F.col("type") != "score_revision", F.col("type").isin("assert", "score_revision")
    st = e.groupBy("store", "claim_id").agg(
        F.max_by("type", F.when(structural, F.col("seq"))).alias("last"), F.max_by("score", F.when(scored, F.col("seq"))).alias("want"), F.max((F.col("type") == "assert").cast("int")).alias("said")
    )
    live = tables["claims"].where("txn_to IS NULL").groupBy("store", "claim_id").agg(F.min("score").alias("have"), F.lit(True).alias("live"))
    j = st.where("said = 1").join(live, ["store", "claim_id"], "left")
    problem = (
        F.when((F.col("last") == "assert") & F.col("live").isNull(), "asserted-not-live").when((F.col("last") != "assert") & F.col("live"), "ended-but-live")
        .when((F.col("last") == "assert") & (F.abs(F.col("have") - F.col("want")) > SAME), "score-differs")
    )
    out = j.select("store", "claim_id", problem.alias("problem")).where("problem IS NOT NULL")
    named = None
    for rank, (name, columns) in enumerate(NAMES.items()):
        for c in columns if name in tables else ():
            rows = tables[name].select("store", F.col(c).alias("claim_id"), F.lit(rank).alias("rank"), F.lit(name).alias("name"))
            named = rows if named is None else named.unionByName(rows)
    first = named.where("claim_id IS NOT NULL").groupBy("store", "claim_id").agg(F.min_by("name", "rank").alias("name"))
    lost = first.join(st.where("said = 1").select("store", "claim_id"), ["store", "claim_id"], "left_anti")
    return out.unionByName(lost.select("store", "claim_id", F.concat(F.lit("no-assert: "), "name").alias("problem")))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for key, message, sig in zip(*(b.column(c).to_pylist() for c in ("pubkey", "message", "sig"))):
            try:
                ok.append(C.verify(bytes.fromhex(key), message, bytes.fromhex(sig)))
            except (ValueError, TypeError):
                ok.append(False)
        keep = [i for i, n in enumerate(b.schema.names) if n not in ("pubkey", "message", "sig")]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(ok, pa.bool_())], names=[*(b.schema.names[i] for i in keep), "valid"])


def signed(rows: DataFrame) -> DataFrame:
    """rows (pubkey and sig as hex, message as binary, others) without these three and with ``valid``; in Arrow batches."""
    rest = [f for f in rows.schema.fields if f.name not in ("pubkey", "message", "sig")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return rows.select(*(f.name for f in rest), "pubkey", "message", "sig").mapInArrow(_check, f"{kinds}, valid boolean")


def verdict_signatures(log: DataFrame) -> DataFrame:
    """``store, seq, valid`` of the signed verdicts of a log: by the key that the signer had when it signed.

    A later change of the key does not matter; without a key at that time a signature is not valid.
    """
    v = log.where(F.col("p.signature").isNotNull() & F.col("p.signed_message").isNotNull()).select("store", "seq", F.col("p.signer").alias("signer"), F.encode("p.signed_message", "UTF-8").alias("message"), F.col("p.signature").alias("sig"))
    return signed(fold.lookup(log, "writers", v, "signer").drop("tier", "signer"))


def required_signature(verdicts: DataFrame, log: DataFrame) -> DataFrame:
    """verdicts (store, seq, writer, message, signature) with ``problem``: ``signature-required``, ``invalid`` or null.

    A writer with a registered key must sign; one without acts unsigned.
    """
    v = fold.lookup(log, "writers", verdicts, "writer").withColumn("pubkey", F.col("pubkey"))
    checked = signed(v.where("pubkey IS NOT NULL AND signature IS NOT NULL").select("store", "seq", "writer", "pubkey", F.encode("message", "UTF-8").alias("message"), F.col("signature").alias("sig")))
    out = v.join(checked, ["store", "seq", "writer"], "left")
    problem = F.when(F.col("pubkey").isNull(), None).when(F.col("signature").isNull(), "signature-required").when(~F.col("valid"), "invalid")
    return out.select(*verdicts.columns, problem.alias("problem"))


def key_history(log: DataFrame, genesis_id: str, genesis_key: str) -> tuple[DataFrame, DataFrame]:
    """(windows, problems) of a governed log: enrollments and revocations count only if an authorised key signed them.

    windows: store, key_id, pubkey, role, enrolled_seq, revoked_seq.  Who may enroll depends on what was enrolled before,
    so the key records of a store, and no others, are read in one task in order.
    """
    rows = log.where(F.col("type").isin("key_enrollment", "key_revocation")).select("store", "seq", "actor", "type", "hash", "sig", F.col("p.key_id").alias("key_id"), F.col("p.pubkey").alias("pubkey"), F.col("p.role").alias("role"))

    def valid(key: str, h: str, sig: str) -> bool:
        try:
            return C.verify(bytes.fromhex(key), bytes.fromhex(h), bytes.fromhex(sig))
        except (ValueError, TypeError):
            return False

    def read(t: pa.Table) -> pa.Table:
        held: dict[str, list[dict]] = {}
        bad: list[tuple[int, str]] = []

        def judge(r: dict) -> str | None:
            if r["sig"] is None:
                return None  # reported with all unsigned records
            root = r["actor"] == genesis_id
            mine = [w for w in held.get(r["actor"], []) if w["revoked_seq"] is None]
            if not root and not mine:
                return None  # reported with all records without a key in force
            if not valid(genesis_key if root else mine[0]["pubkey"], r["hash"], r["sig"]):
                return None  # reported with all invalid signatures
            if not root and mine[0]["role"] != "admin":
                return "without-authority"
            at = held.setdefault(r["key_id"], []) if r["key_id"] else []
            now = [w for w in at if w["revoked_seq"] is None]
            if r["type"] == "key_revocation":
                if r["key_id"] is None:
                    return "malformed"
                if r["key_id"] == genesis_id:
                    return "genesis-revoked"
                if not now:
                    return "nothing-to-revoke"
                now[0]["revoked_seq"] = r["seq"]
                return None
            try:
                sound = r["key_id"] is not None and r["role"] in ROLES and len(bytes.fromhex(r["pubkey"] or "")) == 32
            except ValueError:
                sound = False
            if not sound:
                return "malformed"
            if now:
                return "already-enrolled"
            at.append({"key_id": r["key_id"], "pubkey": r["pubkey"], "role": r["role"], "enrolled_seq": r["seq"], "revoked_seq": None})
            return None

        rows = sorted(t.to_pylist(), key=lambda r: r["seq"])
        for r in rows:
            problem = judge(r)
            if problem:
                bad.append((r["seq"], problem))
        out = [(w["key_id"], w["pubkey"], w["role"], w["enrolled_seq"], w["revoked_seq"], None) for at in held.values() for w in at]
        out += [(None, None, None, seq, None, problem) for seq, problem in bad]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        store = rows[0]["store"] if rows else None
        return pa.table([pa.array([store] * len(out), pa.string()), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["store", "key_id", "pubkey", "role", "enrolled_seq", "revoked_seq", "problem"])

    got = rows.groupBy("store").applyInArrow(read, "store string, key_id string, pubkey string, role string, enrolled_seq long, revoked_seq long, problem string")
    return got.where("problem IS NULL").drop("problem"), got.where("problem IS NOT NULL").select("store", F.col("enrolled_seq").alias("seq"), "problem")


def governed(log: DataFrame, genesis_id: str, genesis_key: str) -> DataFrame:
    """``store, seq, problem`` of a governed log: broken chain, unsigned, key not in force, signature, role, key records.

    Every record must be signed by a key in force at its seq, ordinary ones by a writer (or the genesis key).
    """
    windows, problems = key_history(log, genesis_id, genesis_key)
    out = problems.unionByName(chain.chain_problems(log))
    out = out.unionByName(log.where("sig IS NULL").select("store", "seq", F.lit("unsigned").alias("problem")))
    r = log.where("sig IS NOT NULL").select("store", "seq", "actor", "type", "hash", "sig")
    w = windows.withColumnRenamed("key_id", "actor")
    covers = (F.col("enrolled_seq") < F.col("seq")) & (F.col("revoked_seq").isNull() | (F.col("seq") <= F.col("revoked_seq")))
    own = r.where(F.col("actor") == genesis_id).withColumns({"pubkey": F.lit(genesis_key), "role": F.lit("genesis")})
    other = r.where(F.col("actor") != genesis_id)
    held = other.join(w, ["store", "actor"]).where(covers).drop("enrolled_seq", "revoked_seq")
    none = other.join(held.select("store", "seq"), ["store", "seq"], "left_anti").join(w.where("revoked_seq IS NOT NULL").groupBy("store", "actor").agg(F.min("revoked_seq").alias("gone")), ["store", "actor"], "left")
    out = out.unionByName(none.select("store", "seq", F.when(F.col("gone") < F.col("seq"), "revoked-key").otherwise("unenrolled-key").alias("problem")))
    checked = signed(own.unionByName(held).withColumn("message", F.unhex("hash")))
    ordinary = ~F.col("type").isin("key_enrollment", "key_revocation")
    problem = F.when(~F.col("valid"), "invalid-signature").when(ordinary & ~F.col("role").isin("genesis", "writer"), "not-a-writer")
    return out.unionByName(checked.select("store", "seq", problem.alias("problem")).where("problem IS NOT NULL"))


def first_break(log: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """``store, seq, problem, checked``: each store's first problem, if any (null: none), and how many records were checked.

    With ``trusted`` (store, seq, hash) only the records after that seq are checked, the first of them against that hash.
    """
    if trusted is None:
        bad, n = chain.chain_problems(log), log.groupBy("store").agg(F.count("*").alias("checked"))
    else:
        t = trusted.select("store", F.col("seq").alias("from_seq"), F.col("hash").alias("from_hash"))
        after = log.join(t, "store").where("seq > from_seq")
        broken = after.where("seq = from_seq + 1 AND prev_hash <> from_hash").select("store", "seq", F.lit("BadPrevHash").alias("problem"))
        near = log.join(t, "store").where("seq >= from_seq").drop("from_seq", "from_hash")
        bad = chain.chain_problems(near).join(t, "store").where("seq > from_seq").select("store", "seq", "problem").unionByName(broken)
        n = after.groupBy("store").agg(F.count("*").alias("checked"))
    first = bad.groupBy("store").agg(F.min(F.struct("seq", "problem")).alias("m")).select("store", "m.*")
    return n.join(first, "store", "left").select("store", "seq", "problem", "checked")


def consistent(older: dict, newer: dict, links: list[dict]) -> bool:
    """Does a signed head extend an older one, by the checkpoints between them (in order)?  Signatures are checked apart."""
    steps = newer["checkpoint_seq"] - older["checkpoint_seq"]
    if steps < 0 or len(links) != steps:
        return False
    root, size = older["root"], older["tree_size"]
    for x in links:
        if x["prev_root"] != root or x["first_seq"] != size + 1 or x["last_seq"] <= size:
            return False
        root, size = x["root"], x["last_seq"]
    return root == newer["root"] and size == newer["tree_size"]


def consistent_heads(pairs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """pairs (store, from_no, from_size, from_root, to_no, to_size, to_root; no = number of full segments) with ``consistent``.

    The links between two heads are looked up in checkpoints (store, no, first_seq, last_seq, root, prev_root; no from 0).
    A chain of links is whole if as many follow on the one before as there are, so no task reads a chain in order.
    """
    c = checkpoints.withColumn("at", F.col("no") + 1)
    before = c.select("store", (F.col("at") + 1).alias("at"), F.col("root").alias("b_root"), F.col("last_seq").alias("b_last"))
    c = c.join(before, ["store", "at"], "left").withColumn("follows", F.coalesce((F.col("prev_root") == F.col("b_root")) & (F.col("first_seq") == F.col("b_last") + 1), F.lit(False)))
    p = pairs.withColumn("_id", F.xxhash64(*pairs.columns))
    j = p.join(c, "store", "left").where((F.col("at") > F.col("from_no")) & (F.col("at") <= F.col("to_no")))
    first = (F.col("at") == F.col("from_no") + 1) & (F.col("prev_root") == F.col("from_root")) & (F.col("first_seq") == F.col("from_size") + 1)
    last = (F.col("at") == F.col("to_no")) & (F.col("root") == F.col("to_root")) & (F.col("last_seq") == F.col("to_size"))
    rest = F.col("follows") & (F.col("at") > F.col("from_no") + 1)
    n = j.groupBy("_id").agg(F.count_if(first).alias("first"), F.count_if(last).alias("last"), F.count_if(rest).alias("rest"))
    same = (F.col("from_no") == F.col("to_no")) & (F.col("from_size") == F.col("to_size")) & (F.col("from_root") == F.col("to_root"))
    linked = (F.col("from_no") < F.col("to_no")) & (F.col("first") == 1) & (F.col("last") == 1) & (F.col("rest") == F.col("to_no") - F.col("from_no") - 1)
    out = p.join(n, "_id", "left")
    return out.select(*pairs.columns, F.coalesce(same | linked, F.lit(False)).alias("consistent"))


def health(log: DataFrame, problems: DataFrame | None = None, segment: int = chain.SEGMENT) -> DataFrame:
    """``store, events, live_claims, head_seq, head_hash, checkpoints, unsigned, problems, ok``, a row for each store."""
    live = fold.claim_versions(log).where("txn_to IS NULL").groupBy("store").agg(F.countDistinct("claim_id").alias("live_claims"))
    n = log.groupBy("store").agg(F.count("*").alias("events"), F.max("seq").alias("head_seq"), F.max_by("hash", "seq").alias("head_hash"), F.count_if(F.col("sig").isNull()).alias("unsigned"))
    bad = (chain.chain_problems(log) if problems is None else problems).groupBy("store").agg(F.count("*").alias("problems"))
    out = n.join(live, "store", "left").join(bad, "store", "left").fillna(0, ["live_claims", "problems"])
    return out.select("store", "events", "live_claims", "head_seq", "head_hash", F.floor(F.col("head_seq") / segment).alias("checkpoints"), "unsigned", "problems", (F.col("problems") == 0).alias("ok"))


def slug_ok(tenant: Column) -> Column:
    """Is it 1 to 64 of a-z, 0-9 and -, beginning with a letter or digit?"""
    return F.coalesce(tenant.rlike(r"\A[a-z0-9][a-z0-9-]{0,63}\z"), F.lit(False))


def tenant_folder(root: str, tenant: str) -> str:
    """The folder of a tenant, always directly below root."""
    if not isinstance(tenant, str) or not 1 <= len(tenant) <= 64 or tenant[0] == "-" or set(tenant) - set("abcdefghijklmnopqrstuvwxyz0123456789-"):
        raise ValueError(f"not a tenant: {tenant!r}")
    return f"{root.rstrip('/')}/{tenant}"


def topics(groups: DataFrame, claims: DataFrame) -> DataFrame:
    """``claim_id, topic`` for the members (node, group_id) of groups of same claims that have no topic yet; claims: claim_id, topic."""
    have = claims.where("topic IS NOT NULL").select(F.col("claim_id").alias("node"))
    return groups.join(have, "node", "left_anti").select(F.col("node").alias("claim_id"), F.concat(F.lit("prop:"), "group_id").alias("topic"))
