"""Passages with insertions, deletions and substitutions: nothing wrong is found, and at least 0.9 of each kind are."""

import random

import numpy as np
import pytest

from beliefloom.llm import contamination as C
from tests.llm.test_documents import least_distance


def edited(w, n, kind, rng):
    w = list(w)
    for k in range(n):
        at = rng.randrange(len(w))
        w[at : at + (kind != "insertion")] = [] if kind == "deletion" else [f"new{k}"]
    return w


@pytest.mark.parametrize("most", [100_000, 0])
@pytest.mark.parametrize("run, edits", [(12, 2), (10, 1)])
def test_against_brute_force(spark, monkeypatch, most, run, edits):
    monkeypatch.setattr(C, "INDEX_WINDOWS", most)
    rng = random.Random(run + edits)
    voc = [f"v{i}" for i in range(30)]
    items = [(i, [rng.choice(voc) for _ in range(rng.randrange(run - 1, 3 * run))]) for i in range(6)]
    docs = []
    for i in range(40):
        src = edited(rng.choice(items)[1], rng.randrange(5), rng.choice(["substitution", "insertion", "deletion"]), rng)
        docs.append((i, [rng.choice(voc) for _ in range(rng.randrange(8))] + src + [rng.choice(voc) for _ in range(rng.randrange(8))]))
    want = set()
    for d, t in docs:
        for k, w in items:
            for size in C.sizes_of(len(w), run):
                far = C.allowed(size, run, edits)
                for i in range(len(w) - size + 1):
                    for p in range(len(t)):
                        if len(t) >= run - edits and (n := least_distance(w[i : i + size], t[p : p + size + far])) <= far:
                            want.add((d, k, size, p, i, n))
    make = lambda rows: spark.createDataFrame([(k, " ".join(w), 1) for k, w in rows], "k long, body string, pos int")
    got = [tuple(r) for r in C.window_matches(make(docs), "k", "body", make(items), "k", "body", run=run, edits=edits).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    for size in {x[2] for x in want}:
        for n in range(edits + 1):
            all_ = {x for x in want if x[2] == size and x[5] == n}
            assert len(all_ & set(got)) >= (0.9 if n else 1) * len(all_)


@pytest.mark.parametrize("kind", ["substitution", "insertion", "deletion"])
@pytest.mark.parametrize("size, n", [(12, 1), (12, 2), (48, 4)])
def test_recall_of_each_kind(kind, size, n):
    """Random windows in 20,000 words: how many share a key with their edited form."""
    rng = random.Random(size + n)
    keys = C.keys_for(size, C.allowed(size, 12, 2), C.RECALL)
    flat = [[rng.getrandbits(62) + 1 for _ in range(size + n)] for _ in range(1500)]
    other = [edited(x[:size], n, kind, rng) + x[size:] for x in flat]
    other = [[y if isinstance(y, int) else hash(y) % (1 << 62) + 1 for y in x] for x in other]
    a, b = (C.embedding_keys(np.array([y for x in rows for y in x], np.uint64), np.cumsum([0] + [len(x) for x in rows])[:-1], size, 0, keys) for rows in (flat, other))
    assert (a == b).any(axis=0).mean() >= 0.92


def test_higher_recall_takes_more_keys():
    assert C.keys_for(12, 2, 0.8) < C.keys_for(12, 2, 0.9) < C.keys_for(12, 2, 0.99)
    with pytest.raises(ValueError):
        C.keys_for(12, 5, 0.9999, places=12)


def test_insertions_and_deletions(spark):
    item = [f"x{i}" for i in range(14)]
    docs = {1: [*item[:7], "new", *item[7:]], 2: [*item[:7], *item[8:]], 3: [*item[:4], "a", *item[5:9], "b", *item[10:]], 4: [f"y{i}" for i in range(30)]}
    make = lambda rows: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], "k long, body string")
    got = {r.doc: r.near for r in C.leaks(make(docs), "k", "body", make({9: item}), "k", "body").collect()}
    assert set(got) == {1, 2, 3} and all(got.values())
