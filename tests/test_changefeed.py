import random

import pytest

from beliefloom.operators.changefeed import apply_changes

DDL = "k string, seq long, op string, a int, b string, _op int, `_k0` string"


def brute(rows):
    state = {}
    seen = set()
    for k, seq, op, a, b in sorted(rows, key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0, r[4] is not None, r[4] or "")):
        if (k, seq) in seen:
            continue
        seen.add((k, seq))
        if op == "insert":
            state[k] = [a, b]
        elif op == "delete":
            state.pop(k, None)
        elif k in state:
            state[k] = [a if a is not None else state[k][0], b if b is not None else state[k][1]]
    return {(k, *v) for k, v in state.items()}


@pytest.mark.parametrize("segment", [1 << 20, 4])
def test_random_feeds(spark, segment):
    rng = random.Random(5)
    rows = [(rng.choice("xyz") if rng.random() < 0.6 else "hot", rng.randrange(60), rng.choice(["insert", "update", "update", "delete"]), rng.choice([None, 1, 2]), rng.choice([None, "p", "q"])) for _ in range(200)]
    rows += rows[:30]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], DDL)
    got = {tuple(r) for r in apply_changes(df, ["k"], "seq", "op", ["a", "b"], segment=segment).collect()}
    assert got == brute(rows)


def test_defined_cases(spark):
    one = lambda rows: {tuple(r) for r in apply_changes(spark.createDataFrame(rows, DDL), ["k"], "seq", "op", ["a", "b"]).collect()}
    assert one([]) == set()
    assert one([(None, 1, "insert", 1, None, 1, ""), ("x", None, "insert", 1, None, 1, ""), ("y", 1, "other", 1, None, 1, "")]) == set()
    assert one([("x", 1, "update", 1, None, 1, "")]) == set()
    assert one([("x", 2, "update", 5, None, 1, ""), ("x", 1, "insert", None, "", 1, "")]) == {("x", 5, "")}
    assert one([("x", 1, "insert", 1, "p", 1, ""), ("x", 2, "delete", None, None, 1, ""), ("x", 3, "insert", None, None, 1, "")]) == {("x", None, None)}
