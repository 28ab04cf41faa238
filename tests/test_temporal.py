import random

from beliefloom.operators.temporal import asof_join


def run(spark, ev, ver, **kw):
    e = spark.createDataFrame(ev, "k string, t long, _k int, _t string")
    v = spark.createDataFrame(ver, "k string, f long, score double, extra string")
    return sorted(map(tuple, asof_join(e, v, key="k", event_time="t", version_time="f", attributes=["score"], **kw).collect()), key=repr)


def brute(ev, ver):
    out = []
    for k, t, a, b in ev:
        fit = [(f, s) for kk, f, s, _ in ver if kk is not None and kk == k and f is not None and t is not None and f <= t]
        if fit:
            top = max(f for f, _ in fit)
            out.append((k, t, a, b, top, min((s for f, s in fit if f == top), key=lambda s: (s is not None, s or 0))))
    return sorted(out, key=repr)


def test_random(spark):
    rng = random.Random(3)
    ev = [(rng.choice(["a", "b", "hot", None]), rng.choice([None, rng.randrange(50)]), i % 3, "x") for i in range(150)]
    ver = [(rng.choice(["a", "hot", "hot", None]), rng.choice([None, rng.randrange(50)]), rng.choice([None, 0.1, 0.5]), "") for _ in range(60)]
    for bucket, full in ((7, 1_000_000), (1000, 1_000_000), (1000, 3)):  # the last one divides crowded buckets
        assert run(spark, ev + ev[:9], ver + ver[:9], bucket=bucket, full=full) == brute(ev + ev[:9], ver + ver[:9])


def test_empty(spark):
    assert run(spark, [], [("a", 1, 0.5, "")]) == []
    assert run(spark, [("a", 1, 0, "")], []) == []
    assert run(spark, [("a", 1, 0, "")], [("a", 1, 0.5, "")]) == [("a", 1, 0, "", 1, 0.5)]  # known at its very instant
