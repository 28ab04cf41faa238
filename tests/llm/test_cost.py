"""A binding attention cost."""

import random

from beliefloom.llm import packing as P


def test_cost_binds(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, "belief " * rng.randrange(1, 500)) for i in range(120)] + [(500, "belief " * 2500)], "doc long, body string")
    most = P.CAPACITY**2 / 10
    by = {}
    for r in P.pack(df, "doc", "body", max_cost=most).collect():
        by.setdefault(r.sequence, []).append(r.n_tokens)
    assert sum(map(len, by.values())) >= 121
    assert all(len(x) == 1 or sum(n * n for n in x) <= most for x in by.values())
    assert any(x[0] ** 2 > most for x in by.values())
    assert len(by) > len({r.sequence for r in P.pack(df, "doc", "body").collect()})
