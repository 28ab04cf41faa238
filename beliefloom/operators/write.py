"""Building events: every write operator as a validated row for the log.  Nothing here touches storage."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from beliefloom.functions import canonical as C
from beliefloom.operators import governance

#: The vocabularies that events are checked against.
SUPPORT_KINDS = ("deductive", "evidential", "llm-generated", "human-asserted")
TERMINAL = ("superseded", "entered-in-error", "dead")
ENTRENCHMENT = {"axiomatic": 1.0, "measured": 0.75, "inferred": 0.5, "provisional": 0.25, "deprecated": 0.0}
COMBOS = ("noisy-and", "noisy-or")
WRITER_TIERS = ("owner", "contributor", "provisional")
DEFAULT_GRAPH = "public"


def _unit(name: str, x: float) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 <= x <= 1:
        raise ValueError(f"{name} must lie between 0 and 1, not {x!r}")
    return float(x)


def _one_of(name: str, x: str, allowed: Sequence[str]) -> str:
    if x not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}, not {x!r}")
    return x


def _given(**texts: str) -> None:
    for name, x in texts.items():
        if not isinstance(x, str) or not x.strip():
            raise ValueError(f"{name} must be given")


def event(kind: str, payload: Mapping, actor: str = "system", t: str | None = None) -> dict:
    """An event with an id derived from its content, so building it twice gives the same row."""
    t = t or datetime.now(timezone.utc).isoformat()
    body = {"t": t, "actor": actor, "type": kind, "payload": {k: v for k, v in payload.items() if v is not None}}
    return {"event_id": "E" + hashlib.sha256(C.canonical(body).encode()).hexdigest()[:32], **body}


def as_row(e: Mapping, store: str, seq: int) -> tuple:
    """(store, seq, t, actor, type, payload as JSON) for a record table."""
    return store, seq, e["t"], e["actor"], e["type"], json.dumps(e["payload"], ensure_ascii=False, separators=(",", ":"))


def assert_claim(claim_id: str, statement: str, prior: float, *, writer: str | None = None, entrenchment: float | str | None = None, materiality: float = 0.05, critical: bool = False, score_kind: str = "credence", source: str | None = None, falsifier: str | None = None, does_not_establish: str | None = None, valid_from: str | None = None, valid_to: str | None = None, **at) -> dict:
    _given(claim_id=claim_id, statement=statement)
    if isinstance(entrenchment, str):
        entrenchment = ENTRENCHMENT[_one_of("entrenchment", entrenchment, tuple(ENTRENCHMENT))]
    elif entrenchment is not None:
        entrenchment = _unit("entrenchment", entrenchment)
    return event("assert", {
        "claim_id": claim_id, "statement": statement, "prior": _unit("prior", prior), "writer": writer, "entrenchment": entrenchment, "materiality": _unit("materiality", materiality),
        "critical": bool(critical), "score_kind": score_kind, "source": source, "falsifier": falsifier, "does_not_establish": does_not_establish, "valid_from": valid_from, "valid_to": valid_to,
    }, **at)


def revise_score(claim_id: str, old: float, new: float, *, because: str | None = None, **at) -> dict:
    """A revision; without ``because`` (a triggering event) and by actor ``human`` it counts as an override."""
    return event("score_revision", {"claim_id": claim_id, "old_score": _unit("old", old), "new_score": _unit("new", new), "triggering_event_id": because}, **at)


def set_entrenchment(claim_id: str, old: float, new: float | str, **at) -> dict:
    new = ENTRENCHMENT[_one_of("tier", new, tuple(ENTRENCHMENT))] if isinstance(new, str) else _unit("new", new)
    return event("entrenchment_set", {"claim_id": claim_id, "old": _unit("old", old), "new": new}, **at)


def supersede(old_claim: Mapping, new_claim_id: str, statement: str, prior: float, *, reason: str, source: str, **at) -> list[dict]:
    """Two events at one time: the successor's assert, then the supersession.

    The successor takes over materiality, critical and entrenchment; writer, edges and falsifier are not carried over.
    """
    _given(reason=reason, source=source)
    at.setdefault("t", datetime.now(timezone.utc).isoformat())
    first = assert_claim(new_claim_id, statement, prior, entrenchment=old_claim["entrenchment"], materiality=old_claim["materiality"], critical=old_claim["critical"], **at)
    return [first, event("supersede", {"old_claim_id": old_claim["claim_id"], "new_claim_id": new_claim_id, "reason": reason, "source": source}, **at)]


def set_status(claim_id: str, status: str, *, reason: str, source: str, **at) -> dict:
    _given(reason=reason, source=source)
    return event("claim_status_changed", {"claim_id": claim_id, "status": _one_of("status", status, TERMINAL[1:]), "reason": reason, "source": source}, **at)


def add_support(claim_id: str, supports_id: str, kind: str, p_given: float, p_given_not: float, strength: float = 1.0, **at) -> dict:
    if claim_id == supports_id:
        raise ValueError("a claim does not support itself")
    return event("support", {"claim_id": claim_id, "supports_id": supports_id, "kind": _one_of("kind", kind, SUPPORT_KINDS), "p_given": _unit("p_given", p_given), "p_given_not": _unit("p_given_not", p_given_not), "strength": _unit("strength", strength)}, **at)


def retract_support(claim_id: str, supports_id: str, **at) -> dict:
    return event("retract_support", {"claim_id": claim_id, "supports_id": supports_id}, **at)


def set_combo(claim_id: str, combo: str, leak: float, strengths: Mapping[str, float], **at) -> dict:
    return event("combo_set", {"claim_id": claim_id, "combo": _one_of("combo", combo, COMBOS), "leak": _unit("leak", leak), "strengths": {k: _unit("strength", v) for k, v in strengths.items()}}, **at)


def register_writer(writer_id: str, tier: str, pubkey: str | None = None, **at) -> dict:
    return event("writer_registered", {"writer_id": writer_id, "tier": _one_of("tier", tier, WRITER_TIERS), "pubkey": pubkey}, **at)


def register_policy(name: str, version: int, description: str, rule: Mapping | None = None, **at) -> dict:
    if rule is not None:
        governance.validate(rule)
    return event("policy_registered", {"name": name, "version": int(version), "description": description, "rule": rule}, **at)


def register_graph(graph: str, ceiling: float, **at) -> dict:
    return event("graph_registered", {"graph": graph, "ceiling": _unit("ceiling", ceiling)}, **at)


def assign_graph(claim_id: str, graph: str, **at) -> dict:
    return event("graph_assigned", {"claim_id": claim_id, "graph": graph}, **at)


def assign_topic(claim_id: str, topic: str, **at) -> dict:
    return event("topic_assigned", {"claim_id": claim_id, "topic": topic}, **at)


def set_interval(claim_id: str, belief: float, plausibility: float, **at) -> dict:
    if _unit("belief", belief) > _unit("plausibility", plausibility):
        raise ValueError("belief must not exceed plausibility")
    return event("interval_set", {"claim_id": claim_id, "belief": belief, "plausibility": plausibility}, **at)


def record_outcome(claim_id: str, outcome: bool, **at) -> dict:
    return event("outcome", {"claim_id": claim_id, "outcome": bool(outcome)}, **at)


def record_decision(decision_id: str, label: str, basis: Sequence[str], rationale: str | None = None, **at) -> dict:
    if not basis:
        raise ValueError("a decision rests on at least one claim")
    return event("decision", {"decision_id": decision_id, "label": label, "basis": list(dict.fromkeys(basis)), "rationale": rationale}, **at)


def declare_contradiction(claim_a: str, claim_b: str, effect: str, *, p_loser_given_winner: float = 0.1, policy: str | None = None, writer: str | None = None, **at) -> dict:
    """What a declaration becomes under the gate's effect: a contradiction, a held one, or a denial."""
    pair = {"claim_a": claim_a, "claim_b": claim_b, "p_loser_given_winner": _unit("p_loser_given_winner", p_loser_given_winner), "writer": writer}
    kind = {"allow": "contradiction", "hold": "contradiction_held", "deny": "policy_denied"}[effect]
    return event(kind, pair | ({"policy": policy} if effect != "allow" else {}), **at)


def escalate(held: Mapping, release: bool, owner: str, tier: str | None, **at) -> dict:
    """An owner releases a held contradiction or dismisses it."""
    if tier != "owner":
        raise PermissionError("only an owner decides on held contradictions")
    pair = {"claim_a": held["claim_a"], "claim_b": held["claim_b"], "escalated_by": owner}
    return event("contradiction", pair | {"released_from": held["event_id"]}, **at) if release else event("contradiction_dismissed", pair | {"held_id": held["event_id"]}, **at)


def verdict_message(action: str, target: str, writer: str, decision: str | None = None, *, domain: str = "beliefloom/verdict/v1") -> bytes:
    """What the signature of a verdict covers: domain, action, target, writer and decision, joined by bars.

    ``domain`` keeps signatures of one system from passing in another; give that of the system whose signatures are read.
    """
    parts = [domain, f"action={action}", f"id={target}", f"writer={writer}", *([f"decision={decision}"] if decision is not None else [])]
    return "|".join(parts).encode()


def signed(e: dict, seed: bytes, signer: str, message: bytes) -> dict:
    return e | {"payload": e["payload"] | {"signer": signer, "signed_message": message.decode(), "signature": C.sign(seed, message).hex()}}


def apply_tier(claim: Mapping, tier: str, **at) -> dict:
    """The entrenchment that a named tier stands for, for a claim (claim_id, entrenchment)."""
    return set_entrenchment(claim["claim_id"], claim["entrenchment"], _one_of("tier", tier, tuple(ENTRENCHMENT)), **at)


def ensure_policy(live: Mapping | None, name: str, version: int, description: str, rule: Mapping | None = None, **at) -> dict | None:
    """register_policy(), or nothing if that version is the live one (a row of the register) already; going back is an error."""
    if live is not None and int(version) <= live["version"]:
        if int(version) == live["version"] and description == live["description"]:
            return None
        raise ValueError(f"{name} is at version {live['version']}; a change needs a higher one")
    return register_policy(name, version, description, rule, **at)


def combine_interval(claim_id: str, interval: tuple[float, float] | None, true: float, false: float, either: float, *, refuse: float = 0.99, **at) -> list[dict]:
    """New evidence (masses) combined with a claim's interval: the new interval and what was combined, or one refusal.

    The rule is not used where the conflict is at least ``refuse``.
    """
    if interval is None:
        raise KeyError(claim_id)
    if abs(true + false + either - 1) > 1e-9:
        raise ValueError("masses must sum to 1")
    b, p = interval
    mine = {"true": b, "false": 1 - p, "either": p - b}
    clash = mine["true"] * false + mine["false"] * true
    at.setdefault("t", datetime.now(timezone.utc).isoformat())
    if clash >= refuse:
        return [event("interval_refused", {"claim_id": claim_id, "conflict": clash}, **at)]
    yes = (mine["true"] * (true + either) + mine["either"] * true) / (1 - clash)
    no = (mine["false"] * (false + either) + mine["either"] * false) / (1 - clash)
    now = {"belief": yes, "plausibility": max(yes, 1 - no)}
    return [set_interval(claim_id, now["belief"], now["plausibility"], **at), event("interval_combined", {"claim_id": claim_id, **now, "conflict": clash}, **at)]


def migrate(events: Sequence[Mapping], source_head: str) -> list[tuple[str, str, str, object]]:
    """(t, actor, type, payload) for a chained store: a marker first, then every event; history stays unsigned."""
    marker = {"events": len(events), "source_sha256": hashlib.sha256(source_head.encode()).hexdigest()}
    first = (events[0]["t"] if events else datetime.now(timezone.utc).isoformat(), "system", "migration", marker)
    return [first, *((e["t"], e["actor"], e["type"], e["payload"]) for e in events)]
