"""Rendering the claim matrix and evidence map, and the gate that compares artifacts byte for byte."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefloom.operators import fold


def cell(x: object) -> str:
    """A value in a Markdown table: bars escaped, line breaks as blanks."""
    return "" if x is None else str(x).replace("|", "\\|").replace("\r", "").replace("\n", " ")


#: Claims that a rendered report may have; beyond that, write operators.fold.matrix as a table instead.
MOST = 100_000


def matrix_rows(log: DataFrame) -> list[dict]:
    """The matrix of one store's log in the order of assertion, on the driver; an error if it has more than MOST claims."""
    if fold.matrix(log).limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} claims do not make a report")
    said = log.where("type = 'assert'").groupBy("store", F.col("p.claim_id").alias("claim_id")).agg(F.min_by("p.statement", "seq").alias("statement"))
    m = fold.matrix(log).join(said, ["store", "claim_id"]).orderBy("store", "assert_seq")
    return [r.asDict() for r in m.select("claim_id", "statement", "confidence", "status", "superseded_by").collect()]


def matrix_json(rows: list[dict]) -> str:
    counts = Counter(r["status"] for r in rows)
    return json.dumps({"claims": rows, "counts": dict(sorted(counts.items()))}, indent=2, ensure_ascii=False) + "\n"


def matrix_markdown(rows: list[dict]) -> str:
    head = ["claim_id", "statement", "confidence", "status", "superseded_by"]
    lines = ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[h]) for h in head) + " |" for r in rows]) + "\n"


def map_json(log: DataFrame) -> str:
    """Claims by status, decisions, and per claim the records that mention it."""
    rows = matrix_rows(log)
    for what, df in (("mentions", fold.evidence(log)), ("decisions", fold.decisions(log).where("kind = 'decision'"))):
        if df.limit(10 * MOST + 1).count() > 10 * MOST:
            raise ValueError(f"more than {10 * MOST} {what} do not make a report")
    seen = {r["claim_id"]: r["seqs"] for r in fold.evidence(log).groupBy("claim_id").agg(F.array_sort(F.collect_set("seq")).alias("seqs")).collect()}
    dec = [{"seq": r["seq"], "label": r["label"], "basis": r["basis"]} for r in fold.decisions(log).where("kind = 'decision'").orderBy("seq").collect()]
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["status"], []).append({"claim_id": r["claim_id"], "evidence": seen.get(r["claim_id"], [])})
    return json.dumps({"claims": len(rows), "by_status": by, "decisions": dec}, indent=2, ensure_ascii=False) + "\n"


def validate_matrix(text: str) -> list[str]:
    """Faults of a matrix artifact: what keeps it from being read as one; empty if it is sound."""
    try:
        doc = json.loads(text)
    except ValueError:
        return ["not JSON"]
    if not isinstance(doc, dict) or set(doc) != {"claims", "counts"} or not isinstance(doc["claims"], list) or not isinstance(doc["counts"], dict):
        return ["not a matrix"]
    out, seen = [], set()
    for i, r in enumerate(doc["claims"]):
        if not isinstance(r, dict) or set(r) != {"claim_id", "statement", "confidence", "status", "superseded_by"}:
            out.append(f"claim {i}: other fields")
            continue
        if not isinstance(r["claim_id"], str) or r["claim_id"] in seen:
            out.append(f"claim {i}: no id of its own")
        seen.add(r["claim_id"])
        if r["confidence"] is not None and (isinstance(r["confidence"], bool) or not isinstance(r["confidence"], (int, float)) or not 0 <= r["confidence"] <= 1):
            out.append(f"claim {i}: confidence is no number between 0 and 1")
        if (r["superseded_by"] is not None) != (r["status"] == "superseded"):
            out.append(f"claim {i}: status and successor disagree")
    counts = Counter(r.get("status") for r in doc["claims"] if isinstance(r, dict))
    if not out and dict(counts) != doc["counts"]:
        out.append("counts differ from the claims")
    return out


def gate(artifacts: dict[str, str], folder: str) -> list[str]:
    """Names of artifacts whose file is missing or differs by a byte."""
    out = []
    for name, text in artifacts.items():
        at = Path(folder) / name
        if not at.exists() or hashlib.sha256(at.read_bytes()).digest() != hashlib.sha256(text.encode()).digest():
            out.append(name)
    return out
