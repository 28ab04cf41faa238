import random
from pathlib import Path

import pytest

from beliefloom import session as S
from beliefloom.llm import components as K
from beliefloom.llm.components import components


def brute(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in up}


def shapes():
    rng = random.Random(1)
    n = lambda i: f"v{i:04d}"
    path = [(n(i), n(i + 1)) for i in range(70)]
    rng.shuffle(path)
    ring = [(n(100 + i), n(100 + (i + 1) % 9)) for i in range(9)]
    star = [(n(200), n(201 + i)) for i in range(40)]
    core = [(n(300 + rng.randrange(25)), n(300 + rng.randrange(25))) for _ in range(90)]
    tails = [(n(300 + i), n(400 + i)) for i in range(25)] + [(n(400 + i), n(500 + i)) for i in range(25)]
    two = [(n(600), n(601)), (n(700), n(701)), (n(701), n(702)), (n(702), n(700))]
    loops = [(n(310), n(800)), (n(800), n(801)), (n(801), n(310))]
    dirt = [(None, n(1)), (n(2), None), (n(3), n(3)), *path[:5], *((b, a) for a, b in ring)]
    return path + ring + star + core + tails + two + loops + dirt


@pytest.mark.parametrize("core", [0, K.CORE])
def test_shapes(spark, monkeypatch, core):
    monkeypatch.setattr(K, "CORE", core)
    pairs = shapes()
    df = spark.createDataFrame([(*p, "x", 1) for p in pairs], "a string, b string, u string, group_id int")
    assert {tuple(r) for r in components(df, "a", "b").collect()} == brute(pairs)


@pytest.mark.parametrize("core", [0, K.CORE])
def test_dense_random(spark, monkeypatch, core):
    monkeypatch.setattr(K, "CORE", core)
    rng = random.Random(9)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(200)]
    got = {tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == brute(pairs)


def test_tables_are_released_and_the_plan_stays_small(spark, monkeypatch):
    monkeypatch.setattr(K, "CORE", 0)
    n = 400
    pairs = [(i, (i - 1) // 2) for i in range(1, n)]  # a binary tree is stripped level by level
    folder = Path(S._run_dir(spark).removeprefix("file:"))
    tables = lambda: {p.relative_to(folder).parts[0] for p in folder.rglob("*.parquet")}
    before = tables()
    out = components(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    assert len(tables() - before) <= 3
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2
    assert {tuple(r) for r in out.collect()} == {(i, 0) for i in range(n)}


def test_empty(spark):
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
    assert components(spark.createDataFrame([("x", "x"), (None, None)], "a string, b string"), "a", "b").count() == 0
