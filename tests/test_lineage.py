"""Lineage over edges of every kind, against brute force and the SQL without a restriction by kind."""

import random

import pytest

from beliefloom.operators import contradict, graph
from beliefloom.plans import registry
from tests.test_queries import con, norm  # noqa: F401


def brute(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    anc = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        anc[a] = seen
    return anc


@pytest.mark.parametrize("kernel", [True, False])
@pytest.mark.parametrize("seed, links", [(1, 150), (2, 260)])
def test_lineage(spark, kernel, seed, links, monkeypatch):
    if not kernel:
        monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(200)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(links)] + [("n7", "n7")]
    if seed == 1:
        monkeypatch.setattr(graph, "SET_WORDS", 1)
    anc = brute(pairs)
    e = spark.createDataFrame(pairs, "claim_id string, supports_id string")
    assert {r.claim_id: r.n for r in graph.reached(e, "claim_id", "supports_id").collect()} == {a: len(s) for a, s in anc.items()}
    score = {x: rng.choice([0.05, 0.1, 0.2, 0.5, 0.8, 0.9, 0.95]) for x in [*nodes, "alone"]}
    want = {tuple(sorted((x, y))) for x in anc for y in anc if score[x] > 0.5 > score[y] and score[x] - score[y] >= 0.7 and anc[x] & anc[y]}
    got = [tuple(r) for r in contradict.opposed_lineage(spark.createDataFrame(list(score.items()), "claim_id string, score double"), e).collect()]
    assert len(got) == len(want) and set(got) == want


def test_no_edges(spark):
    e = spark.createDataFrame([], "claim_id string, supports_id string")
    assert graph.reached(e, "claim_id", "supports_id").count() == 0
    assert contradict.opposed_lineage(spark.createDataFrame([("a", 0.9)], "claim_id string, score double"), e).count() == 0


@pytest.mark.parametrize("name", ["fanout", "kill_bars", "detect_opposition"])
def test_every_kind(spark, sf, con, name):  # noqa: F811
    df = registry.QUERIES[name](spark, sf)
    cur = con.execute(registry.ORACLES[name].replace(" WHERE kind = 'deductive'", ""))
    cols = [d[0] for d in cur.description]
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), cols)
