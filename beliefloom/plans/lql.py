"""A small read-only query language, compiled to DataFrames.

    CLAIM <id>                      one live claim
    CLAIMS [WHERE filter]           live claims
    WHY <id> | DEPENDS <id>         supporters; dependents with their distance
    IMPACT <id> [STRUCTURAL | PROPAGATED TO number]
    EVENTS [WHERE filter] | DECISIONS [WHERE filter] | HEALTH
    AS_OF <time> CLAIM | CLAIMS | EVENTS | DECISIONS ...

A filter joins comparisons (= != < <= > >=) with AND, which binds tighter, and OR.  Parsing ends before any job runs;
errors carry the position in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {
    "CLAIMS": {"status": str, "writer": str, "tier": str, "kind": str, "score": float, "entrenchment": float, "materiality": float, "critical": bool},
    "EVENTS": {"type": str, "actor": str, "t": str},
    "DECISIONS": {"kind": str, "actor": str, "label": str},
}
_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^']|'')*')|(?P<number>-?\d[\w.:+\-]*)|(?P<op><=|>=|!=|=|<|>)|(?P<word>[A-Za-z_][\w\-]*))")


class ParseError(ValueError):
    """A query that is not well formed; ``position`` is where."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at position {position}")
        self.position = position


@dataclass
class Plan:
    kind: str
    ident: str | None = None
    filter: tuple | None = None
    as_of: str | None = None
    target: float | None = None


def micros(text: str) -> int:
    """Microseconds of an ISO time, UTC unless it says otherwise."""
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    d = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


class _Tokens:
    def __init__(self, text: str):
        self.items: list[tuple[str, str, int]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                at += len(text[at:]) - len(text[at:].lstrip())
                raise ParseError(f"unexpected {text[at]!r}", at)
            kind = m.lastgroup or ""
            value = m.group(kind)
            self.items.append((kind, value[1:-1].replace("''", "'") if kind == "string" else value, m.start(kind)))
            at = m.end()
        self.items.append(("end", "", len(text)))
        self.at = 0

    def peek(self) -> tuple[str, str, int]:
        return self.items[self.at]

    def take(self, *words: str) -> str | None:
        kind, value, _ = self.peek()
        if kind == "word" and value.upper() in words:
            self.at += 1
            return value.upper()
        return None

    def value(self, what: str, *kinds: str) -> str:
        kind, value, pos = self.peek()
        if kind not in kinds:
            raise ParseError(f"expected {what}", pos)
        self.at += 1
        return value


def parse(text: str) -> Plan:
    t = _Tokens(text)
    as_of = None
    if t.take("AS_OF"):
        pos = t.peek()[2]
        as_of = t.value("a time", "string", "number")
        try:
            micros(as_of)
        except ValueError:
            raise ParseError(f"not a time: {as_of!r}", pos) from None
    start = t.peek()[2]
    head = t.take("CLAIM", "CLAIMS", "WHY", "DEPENDS", "IMPACT", "EVENTS", "DECISIONS", "HEALTH")
    if head is None:
        raise ParseError("expected a query", start)
    if as_of and head not in ("CLAIM", "CLAIMS", "EVENTS", "DECISIONS"):
        raise ParseError(f"AS_OF does not apply to {head}", start)
    plan = Plan(head, as_of=as_of)
    if head in ("CLAIM", "WHY", "DEPENDS", "IMPACT"):
        plan.ident = t.value("an id", "word", "string", "number")
    if head == "IMPACT" and not t.take("STRUCTURAL") and t.take("PROPAGATED"):
        pos = t.peek()[2]
        if not t.take("TO"):
            raise ParseError("expected TO", pos)
        pos = t.peek()[2]
        try:
            plan.target = float(t.value("a number", "number"))
        except ValueError:
            raise ParseError("expected a number", pos) from None
        if not 0 <= plan.target <= 1:
            raise ParseError("a score lies between 0 and 1", pos)
    if head in FIELDS and t.take("WHERE"):
        plan.filter = _or(t, head)
    kind, value, pos = t.peek()
    if kind != "end":
        raise ParseError(f"unexpected {value!r}", pos)
    return plan


def _or(t: _Tokens, head: str) -> tuple:
    left = _and(t, head)
    while t.take("OR"):
        left = ("or", left, _and(t, head))
    return left


def _and(t: _Tokens, head: str) -> tuple:
    left = _compare(t, head)
    while t.take("AND"):
        left = ("and", left, _compare(t, head))
    return left


def _compare(t: _Tokens, head: str) -> tuple:
    pos = t.peek()[2]
    field = t.value("a field", "word").lower()
    if field not in FIELDS[head]:
        raise ParseError(f"{head} has no field {field!r}", pos)
    op = t.value("a comparison", "op")
    kind, value, pos = t.peek()
    want = FIELDS[head][field]
    t.at += 1
    if want is float:
        try:
            return ("cmp", field, op, float(value if kind == "number" else "?"))
        except ValueError:
            raise ParseError(f"{field} takes a number", pos) from None
    if want is bool:
        if kind != "word" or value.lower() not in ("true", "false") or op not in ("=", "!="):
            raise ParseError(f"{field} takes = or != and true or false", pos)
        return ("cmp", field, op, value.lower() == "true")
    if kind not in ("string", "word", "number"):
        raise ParseError(f"{field} takes a text", pos)
    return ("cmp", field, op, value)


def condition(f: tuple, columns: dict[str, Column] | None = None) -> Column:
    """A filter as a column: a null field is unequal to everything and ordered with nothing."""
    if f[0] in ("and", "or"):
        a, b = condition(f[1], columns), condition(f[2], columns)
        return a & b if f[0] == "and" else a | b
    _, field, op, value = f
    c = (columns or {}).get(field, F.col(field))
    test = {"=": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
    return F.coalesce(test, F.lit(op == "!="))


_PARTS = frozenset(("versions", "edges", "log", "decisions", "writers", "combos"))


@dataclass
class Ledger:
    """The DataFrames a query runs over.

    versions: claim_id, from_us, to_us, score, ...; edges: live support edges; log: events with t_us; decisions:
    decision_id, t_us, kind, actor, label, basis; writers: writer, tier (live); combos: claim_id, combo, leak (live).
    """

    versions: DataFrame
    edges: DataFrame
    log: DataFrame
    decisions: DataFrame
    writers: DataFrame | None = None
    combos: DataFrame | None = None

    def __getattribute__(self, name: str):
        # A part may be given as a function that makes it; it is made when a query first reads it.
        value = object.__getattribute__(self, name)
        if name in _PARTS and callable(value):
            value = value()
            object.__setattr__(self, name, value)
        return value

    def query(self, text: str) -> DataFrame:
        return execute(self, parse(text))


def execute(ledger: Ledger, plan: Plan) -> DataFrame:
    from beliefloom.operators import graph
    from beliefloom.operators.history import believed_at, live, why

    at = micros(plan.as_of) if plan.as_of else None
    if plan.kind in ("CLAIM", "CLAIMS"):
        c = live(ledger.versions) if at is None else believed_at(ledger.versions, at)
        if plan.ident:
            return c.where(F.col("claim_id") == plan.ident)
        if plan.filter is None:
            return c
        if ledger.writers is not None:
            c = c.join(ledger.writers, "writer", "left")
        else:
            c = c.withColumn("tier", F.lit(None).cast("string"))
        return c.where(condition(plan.filter, {"kind": F.col("score_kind")})).drop("tier")
    if plan.kind in ("EVENTS", "DECISIONS"):
        e = ledger.log if plan.kind == "EVENTS" else ledger.decisions
        e = e if at is None else e.where(F.col("t_us") <= at)
        return e if plan.filter is None else e.where(condition(plan.filter))
    spark = ledger.versions.sparkSession
    if plan.kind == "WHY":
        return why(ledger.edges.where(F.col("claim_id") == plan.ident), ledger.versions)
    if plan.kind == "HEALTH":
        from beliefloom.operators.chain import chain_problems

        n = ledger.log.agg(F.count("*").alias("events"))
        n = n.unionByName(live(ledger.versions).agg(F.count("*").alias("live_claims")), allowMissingColumns=True)
        if {"hash", "prev_hash", "payload"} <= set(ledger.log.columns):  # a chained log
            n = n.unionByName(chain_problems(ledger.log).agg(F.count("*").alias("problems")), allowMissingColumns=True)
        else:
            n = n.withColumn("problems", F.lit(0).cast("long"))
        row = n.agg(*(F.max(c).alias(c) for c in ("events", "live_claims", "problems")))
        return row.withColumn("ok", F.col("problems") == 0)
    root = spark.createDataFrame([(plan.ident,)], "root string")
    if plan.kind == "DEPENDS":
        return graph.reach(ledger.edges, "supports_id", "claim_id", root).select(F.col("node").alias("claim_id"), "distance")
    known = not live(ledger.versions).where(F.col("claim_id") == plan.ident).isEmpty()
    if not known:
        raise KeyError(plan.ident)
    if plan.target is None:
        return graph.impact(ledger.edges, root, ledger.decisions).drop("root")
    roots = spark.createDataFrame([(plan.ident, plan.target)], "root string, score double")
    from beliefloom.operators.revision import by_attachment

    return graph.revisit(live(ledger.versions), by_attachment(ledger.edges), roots, ledger.combos).drop("root")
