import random

from beliefloom.operators.hierarchy import cycle_members, descendants, hierarchy


def brute(links):
    up = {}
    for c, p in sorted(x for x in links if None not in x):
        up[c] = min(p, up.get(c, p))
    out = {}
    for x in set(up) | set(up.values()):
        path, at = [x], x
        while at in up and up[at] not in path:
            at = up[at]
            path.append(at)
        if at in up:
            ring = path[path.index(up[at]):]
            out[x] = (min(ring), -1, None)
        else:
            out[x] = (path[-1], len(path) - 1, path[::-1])
    return out


def check(spark, links):
    t = hierarchy(spark.createDataFrame([(*x, "z") for x in links], "child string, parent string, node string"), "child", "parent", paths=True).cache()
    got = {r.node: (r.root, r.depth, r.path) for r in t.collect()}
    want = brute(links)
    assert got == want
    below = {(a, n, len(p) - 1 - i) for n, (_, d, p) in want.items() if p for i, a in enumerate(p[:-1])}
    assert {tuple(r) for r in descendants(t).collect()} == below
    return t


def test_random_forest_with_cycles(spark):
    rng = random.Random(2)
    links = [(f"n{i:03d}", f"n{rng.randrange(i):03d}") for i in range(1, 60)]
    links += [(f"c{i:03d}", f"c{i - 1:03d}") for i in range(1, 90)]  # a deep chain
    links += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("below", "r2"), ("lower", "below"), ("self", "self"), ("n005", None), (None, "x")]
    links += links[:20] + [("n010", "zzz")]
    t = check(spark, links)
    assert {tuple(r) for r in cycle_members(t).collect()} == {("r1", 5), ("self", 1)}


def test_numeric_ids(spark):
    t = hierarchy(spark.createDataFrame([(2, 1), (3, 2), (5, 5)], "c long, p long"), "c", "p", paths=True)
    assert {(r.node, r.root, r.depth) for r in t.collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (5, 5, -1)}


def test_empty_and_star(spark):
    assert check(spark, []).count() == 0
    check(spark, [(f"k{i}", "hub") for i in range(200)])


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    from beliefloom.operators import hierarchy as H

    steps = []
    for name in ("cut", "cut_counting", "cut_split"):
        monkeypatch.setattr(H, name, lambda *a, f=getattr(H, name), **k: steps.append(1) or f(*a, **k))
    n = 3000
    t = hierarchy(spark.createDataFrame([(i, i - 1) for i in range(1, n)], "c long, p long"), "c", "p")
    assert {(r.node, r.root, r.depth) for r in t.collect()} == {(i, 0, i) for i in range(n)}
    assert len(steps) <= 4 + H.LEVELS + 13


def test_other_parents(spark):
    from beliefloom.operators.hierarchy import other_parents

    links = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), (None, "x")], "c string, p string")
    assert [tuple(r) for r in other_parents(links, "c", "p").collect()] == [("a", "y")]
