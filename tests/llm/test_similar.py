import random
import re

import numpy as np

import pytest

from beliefloom.llm import neardup as N
from beliefloom.llm.neardup import near_groups, near_links
from beliefloom.llm import splits
from beliefloom.llm.splits import chunk_digests, rolling, split_overlaps

WORD = re.compile(r"[^\W_]+")


def like(a, b):
    a, b = set(WORD.findall(a.lower())), set(WORD.findall(b.lower()))
    return len(a & b) / len(a | b) if a | b else 0.0


def variants(n, seed, vocab=300, length=(3, 40), skew=0.6):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(skew)) % vocab}" if skew else f"w{rng.randrange(vocab)}" for _ in range(4000)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            t = rng.choice(out).split()
            for _ in range(rng.randrange(6)):
                i = rng.randrange(len(t)) if t else 0
                t = t[:i] + rng.choice([[], [rng.choice(words)], [rng.choice(words), *t[i : i + 1]]]) + t[i + 1 :]
            if rng.random() < 0.3:
                rng.shuffle(t)
            out.append(" ".join(t))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(*length))))
    return out


@pytest.mark.parametrize("t,target,hot", [(0.6, 100, 1000), (0.6, 3, 2), (0.8, 3, 1000), (0.5, 2, 1), (0.6, 100, 3)])
def test_near_groups_are_exact(spark, t, target, hot):
    texts = variants(220, seed=int(t * 10) + target)
    rows = [(f"k{i:03d}", x) for i, x in enumerate(texts)] + [("k000", texts[0]), ("zz", None), (None, "w1 w2"), ("e1", ""), ("e2", " -- "), ("copy1", texts[5].upper()), ("copy2", texts[5])]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    good = [r for r in rows if r[0] and r[1] and WORD.search(r[1])]
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[0] != b[0] and like(a[1], b[1]) >= t:
                x, y = find(a[0]), find(b[0])
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(*r, "q", 0.5) for r in rows], "id string, body string, rid string, k double")
    got = {tuple(r) for r in near_groups(df, "id", "body", t, target=target, hot=hot).collect()}
    assert got == {(x, find(x)) for x in up}


def test_near_groups_empty(spark):
    assert near_groups(spark.createDataFrame([], "id string, body string"), "id", "body", 0.6).count() == 0
    with pytest.raises(ValueError):
        near_groups(spark.createDataFrame([("a", "b")], "id string, body string"), "id", "body", 0.3)


@pytest.mark.parametrize("t", [0.5, 0.6, 0.8])
def test_like_records_share_a_signature(t):
    """A smaller record is found by one that a larger one asks with, whatever the frequencies and sizes."""
    rng = random.Random(3)
    df = {i: rng.choice([1, 5, 400, 400, 5000, 5000, 60_000]) for i in range(3000)}
    tried = 0
    for _ in range(300):
        n = rng.choice([1, 2, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 70, 200])
        a = set(rng.sample(sorted(df), n))
        b = set(rng.sample(sorted(a), rng.randrange(1, n + 1))) | set(rng.sample(sorted(df), rng.randrange(n // 2 + 1)))
        if len(a & b) < t * len(a | b) - 1e-12:
            continue
        tried += 1
        a, b = sorted((sorted(x, key=lambda i: (df[i], i)) for x in (a, b)), key=len)
        size = np.array([len(a), len(b)])
        flat = np.array(a + b)
        rec, sig, found, _ = N.Tokens(np.array([df[i] for i in flat]), flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), size, t, 100_000).signatures()
        assert set(sig[(rec == 0) & found]) & set(sig[rec == 1])
    assert tried > 30


def test_signatures_grow_with_the_length():
    rng = np.random.default_rng(1)
    for n in (200, 1000, 5000):
        df = np.sort(np.exp(rng.uniform(np.log(1e4), np.log(1e8), n)).astype(np.int64))
        _, sig, _, _ = N.Tokens(df, rng.integers(0, 1 << 63, n, dtype=np.uint64), np.array([n]), 0.6, 10**9).signatures()
        assert len(sig) <= 20 * n


def test_a_clique_takes_few_links(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    texts = [(f"r{i}".encode(), sorted(set(base) - {rng.choice(base)} | {f"x{i}"})) for i in range(150)]
    links = near_links(spark.createDataFrame([(bytearray(r), w) for r, w in texts], "rid binary, words array<string>"), 0.8).collect()
    assert 149 <= len(links) <= 4 * 150


def test_chunks_cover_and_resync():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    off = np.array([0, 0, 100, 300, 300])
    rec, digest, n = chunk_digests(h, off)
    assert n.sum() == 300 and set(rec) == {1, 2} and n[rec == 1].sum() == 100
    new = h.copy()
    new[190] = 5
    _, other, _ = chunk_digests(new, off)
    assert len(set(digest) - set(other)) <= 3
    # The same words in another record are cut alike once the window has passed its start.
    _, again, _ = chunk_digests(h[120:300], np.array([0, 180]))
    assert len(set(again) - set(digest)) <= 2
    assert len(chunk_digests(h[:0], np.array([0, 0]))[0]) == 0


def test_the_cut_depends_on_a_window_of_words():
    h = np.arange(1, 21, dtype=np.uint64)
    a, b = h.copy(), h.copy()
    b[9] = 99
    off = np.array([0, 20])
    differ = np.flatnonzero(rolling(a, off) != rolling(b, off))
    assert list(differ) == list(range(9, 9 + splits.WINDOW))


@pytest.mark.parametrize("length, t, moved", [((12, 40), 0.7, False), ((1, 7), 0.7, False), ((3, 40), 0.6, True), ((12, 30), 0.8, True)])
def test_split_overlaps(spark, length, t, moved):
    """Exact, also for short texts and for those whose words are moved so that they share no chunk."""
    base = variants(60, seed=8, length=length, skew=None)
    rng = random.Random(2)
    evals = [("dev" if i % 2 else "test", i, x) for i, x in enumerate(base)] + [("dev", 900, None), ("dev", 901, "..."), ("dev", 1, base[1])]
    train = []
    for i in range(150):
        w = rng.choice([x for x in base if x]).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        if moved and i % 2:
            rng.shuffle(w)
        train.append((i, " ".join(w), "src"))
    train += [(7, base[0].upper() + "!", "src"), (500, None, "src"), (501, "", "src")]
    e = spark.createDataFrame([(*x, 1) for x in evals], "split string, prop long, body string, rid int")
    r = spark.createDataFrame(train, "example long, body string, words string")
    got = {(x.split, x.prop, x.example): x for x in split_overlaps(e, ["split", "prop"], r, ["example"], "body", t).collect()}
    want = {(s, p, x) for s, p, a in evals for x, b, _ in train if a and b and WORD.search(a) and WORD.search(b) and like(a, b) >= t}
    assert set(got) == want and want
    assert all(0 <= x.overlap <= 1 + 1e-9 for x in got.values())
    if moved:
        assert any(x.overlap == 0 for x in got.values())
    assert split_overlaps(e.limit(0), ["split", "prop"], r, ["example"], "body", 0.7).count() == 0
