"""Predicate policies as columns, authority ceilings, key windows."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("==", "!=", "<", "<=", ">", ">=", "in", "not_in")
EFFECTS = ("deny", "hold")
ACTIONS = ("declare_contradiction", "resolve_contradiction", "escalate_contradiction")


def validate(rule: Mapping) -> None:
    """Raises ValueError if a policy rule is not well formed."""
    if rule.get("action") not in ACTIONS:
        raise ValueError(f"action must be one of {ACTIONS}")
    if rule.get("effect") not in EFFECTS:
        raise ValueError(f"effect must be one of {EFFECTS}")
    if rule["effect"] == "hold" and rule["action"] != "declare_contradiction":
        raise ValueError("only a declaration can be held")
    validate_predicate(rule.get("when"))


def validate_predicate(p: object) -> None:
    if not isinstance(p, Mapping):
        raise ValueError("a predicate is an object")
    heads = [h for h in ("all", "any", "not", "field") if h in p]
    if len(heads) != 1:
        raise ValueError("a predicate has exactly one of all, any, not, field")
    head = heads[0]
    if head in ("all", "any"):
        if not isinstance(p[head], list) or not p[head]:
            raise ValueError(f"{head} takes a non-empty list")
        for x in p[head]:
            validate_predicate(x)
    elif head == "not":
        validate_predicate(p["not"])
    else:
        if p.get("op") not in OPS or "value" not in p or not isinstance(p["field"], str):
            raise ValueError(f"a leaf has field, op (one of {OPS}) and value")
        if p["op"] in ("in", "not_in") and not isinstance(p["value"], list):
            raise ValueError(f"{p['op']} takes a list")


def predicate(p: Mapping | str, columns: Mapping[str, str]) -> Column:
    """A predicate as a boolean column that is never null.

    ``columns`` has the type (``number``, ``string``, ``boolean``) of each known field.  A missing field makes its leaf
    false; a null field compares like a value that equals nothing (so != and not_in are true, order is false); values
    of another type than the field's are unequal and unordered.
    """
    p = json.loads(p) if isinstance(p, str) else p
    validate_predicate(p)

    def kind(v: object) -> str:
        return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"

    def go(p: Mapping) -> Column:
        if "all" in p:
            return reduce(lambda a, b: a & b, map(go, p["all"]))
        if "any" in p:
            return reduce(lambda a, b: a | b, map(go, p["any"]))
        if "not" in p:
            return ~go(p["not"])
        f, op, v = p["field"], p["op"], p["value"]
        if f not in columns:
            return F.lit(False)
        c = F.col(f)
        if op in ("in", "not_in"):
            like = [x for x in v if x is not None and kind(x) == columns[f]]
            inside = F.coalesce(c.isin(*like), F.lit(False)) if like else F.lit(False)
            if None in v:
                inside = inside | c.isNull()
            return inside if op == "in" else ~inside
        if v is None:
            same = c.isNull()
        else:
            same = F.coalesce(c == F.lit(v), F.lit(False)) if kind(v) == columns[f] else F.lit(False)
        if op in ("==", "!="):
            return same if op == "==" else ~same
        if v is None or kind(v) != columns[f]:
            return F.lit(False)
        return F.coalesce({"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op], F.lit(False))

    return go(p)


def gate(context: DataFrame, rules: Mapping[str, Mapping], action: str, columns: Mapping[str, str]) -> DataFrame:
    """context with ``effect`` (deny before hold, else allow) and the ``policy`` that decided (the first by name)."""
    for r in rules.values():
        validate(r)
    mine = [(n, r) for n, r in sorted(rules.items()) if r["action"] == action]
    effect, policy = F.lit("allow"), F.lit(None).cast("string")
    for want in ("hold", "deny"):
        for n, r in reversed([x for x in mine if x[1]["effect"] == want]):
            hit = predicate(r["when"], columns)
            effect, policy = F.when(hit, F.lit(want)).otherwise(effect), F.when(hit, F.lit(n)).otherwise(policy)
    return context.withColumns({"effect": effect, "policy": policy})


def effective_entrenchment(claims: DataFrame, edges: DataFrame, ceilings: DataFrame) -> DataFrame:
    """claim_id, entrenchment, effective: no more than the ceiling of the claim's own graph and its direct supporters'.

    claims: claim_id, entrenchment, graph (null: no ceiling); ceilings: graph, ceiling.
    """
    c = claims.join(ceilings, "graph", "left").select("claim_id", "entrenchment", F.coalesce("ceiling", F.lit(1.0)).alias("own"))
    sup = edges.select("claim_id", "supports_id").distinct().join(c.select(F.col("claim_id").alias("supports_id"), F.col("own").alias("theirs")), "supports_id")
    low = sup.groupBy("claim_id").agg(F.min("theirs").alias("theirs"))
    return c.join(low, "claim_id", "left").select("claim_id", "entrenchment", F.least("entrenchment", "own", F.coalesce("theirs", F.lit(1.0))).alias("effective"))


def key_windows(log: DataFrame) -> DataFrame:
    """store, key_id, pubkey, role, enrolled_seq, revoked_seq of key enrollments and revocations, in seq order."""
    from beliefloom.operators.ordered import running

    e = log.where(F.col("type").isin("key_enrollment", "key_revocation")).select("store", "seq", "type", F.col("p.key_id").alias("key_id"), F.col("p.pubkey").alias("pubkey"), F.col("p.role").alias("role")).where("key_id IS NOT NULL")
    e = running(e, ["store", "key_id"], "seq", {}, {"next_seq": F.col("seq"), "next_type": F.col("type")})
    return e.where("type = 'key_enrollment'").select("store", "key_id", "pubkey", "role", F.col("seq").alias("enrolled_seq"), F.when(F.col("next_type") == "key_revocation", F.col("next_seq")).alias("revoked_seq"))


def effective_at(windows: DataFrame, records: DataFrame) -> DataFrame:
    """records (store, actor, seq) with the key window that covers them: enrolled < seq < revoked."""
    w = windows.withColumnRenamed("key_id", "actor")
    hit = records.join(w, ["store", "actor"])
    return hit.where((F.col("enrolled_seq") < F.col("seq")) & (F.col("revoked_seq").isNull() | (F.col("seq") < F.col("revoked_seq"))))
