import random
import re

import numpy as np
import pytest

from beliefloom.llm import contamination as C
from beliefloom.llm import packing as P
from beliefloom.llm import residue as R

WORD = re.compile(r"[^\W_]+")


def longest_run(a, b):
    best, prev = 0, {}
    for x in a:
        cur = {}
        for j, y in enumerate(b):
            if x == y:
                cur[j] = prev.get(j - 1, 0) + 1
                best = max(best, cur[j])
        prev = cur
    return best


def test_leaks(spark):
    rng = random.Random(4)
    voc = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.randrange(8, 40)))) for i in range(12)] + [(50, None), (51, ""), (99, None)]
    items[3] = (3, items[2][1])
    docs = []
    for i in range(60):
        t = [rng.choice(voc) for _ in range(rng.randrange(0, 120))]
        if i % 2:
            src = items[rng.randrange(12)][1].split()
            lo = rng.randrange(max(1, len(src) - 8))
            t[10:10] = src[lo : lo + rng.choice([11, 12, 13, 30])]
        docs.append((i, " ".join(t).replace("w1 ", "W1,  ")))
    docs += [(100, None), (101, ""), (102, " ".join(["w5"] * 70_000)), (None, items[0][1]), (1, docs[1][1])]
    d = spark.createDataFrame([(*x, "z", 1) for x in docs], "doc_id long, body string, item string, pos int")
    i = spark.createDataFrame(items, "id long, body string")
    got = {(r.doc, r.item): r.longest for r in C.leaks(d, "doc_id", "body", i, "id", "body").collect() if r.longest}
    want = {}
    for x, a in docs[:60]:
        for y, b in items[:12]:
            n = longest_run(WORD.findall(a.lower()), b.split())
            if n >= 12:
                want[x, y] = n
    assert got == want and want
    assert C.leaks(d.limit(0), "doc_id", "body", i, "id", "body").count() == 0
    assert C.leaks(d, "doc_id", "body", i.limit(0), "id", "body").count() == 0


def test_leaks_without_broadcast_and_with_edits(spark, monkeypatch):
    rng = random.Random(7)
    item = [f"x{i}" for i in range(40)]
    docs = []
    for i in range(200):
        w = item[5:30]
        w[12] = f"new{i}"
        docs.append((i, " ".join([f"y{rng.randrange(999)}" for _ in range(30)] + w)))
    d, t = spark.createDataFrame(docs, "k long, body string"), spark.createDataFrame([(1, " ".join(item))], "k long, body string")
    found = {r.doc for r in C.leaks(d, "k", "body", t, "k", "body").collect()}
    assert len(found) == 200  # verbatim runs of 12 around the edit
    rows = {tuple(r) for r in C.leaks(d, "k", "body", t, "k", "body").collect()}
    assert all(r[4] > 0 for r in rows)
    monkeypatch.setattr(C, "INDEX_WINDOWS", 1)
    assert {tuple(r) for r in C.leaks(d, "k", "body", t, "k", "body").collect()} == rows


def least_distance(x, y):
    """Least edit distance of x to a beginning of y."""
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        diag, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (p != q))
    return min(row)


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_near_distances(edits):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (200, 7)).astype(np.uint64), rng.integers(0, 4, (200, 7 + edits)).astype(np.uint64)
    b[:100, :7] = a[:100]
    b[np.arange(100), rng.integers(0, 7, 100)] = 9
    got = C.near_distances(a.ravel(), np.arange(200) * 7, 7, b.ravel(), np.arange(200) * (7 + edits), edits)
    assert list(got) == [min(edits + 1, least_distance(x, y)) for x, y in zip(a.tolist(), b.tolist())]


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(2)
    for docs, cost in ((256, 1024.0**2), (3, 1024.0**2), (256, 500_000.0)):
        sizes = np.sort(rng.integers(1, 700, 600))[::-1]
        bins = P.vector_best_fit(sizes, 1024, docs, cost)
        for b in np.unique(bins):
            s = sizes[bins == b].astype(float)
            assert s.sum() <= 1024 and len(s) <= docs and (s * s).sum() <= cost
        if docs == 256 and cost == 1024.0**2:
            assert len(np.unique(bins)) <= 1.02 * -(-sizes.sum() // 1024) + 1
    assert len(P.vector_best_fit(np.array([], int), 1024, 9, 1e6)) == 0


def test_pack(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["belief", "ledger", "kélwick", "42"]) for _ in range(rng.randrange(0, 900)))) for i in range(80)]
    texts += [(200, None), (201, ""), (202, "word " * 5000), (203, "<|endoftext|>"), (None, "lost"), (3, texts[3][1])]
    df = spark.createDataFrame([(*t, 5) for t in texts], "doc long, body string, piece int")
    for shard in (20_000, 15):
        rows = P.pack(df, "doc", "body", shard=shard).collect()
        assert {r.doc for r in rows} == {t[0] for t in texts if t[0] is not None}
        per, seqs = {}, {}
        for r in rows:
            per.setdefault(r.doc, []).append(r)
            if r.sequence is not None:
                seqs[r.sequence] = seqs.get(r.sequence, 0) + r.n_tokens
        assert max(seqs.values()) <= 1024
        for x in per.values():
            x.sort(key=lambda r: r.piece)
            assert len(x) == 1 or all(r.n_tokens == 1024 for r in x[:-1])
            assert [r.start for r in x] == [1024 * i for i in range(len(x))]
        assert per[200][0].sequence is None and per[201][0].n_tokens == 0 and len(per[202]) > 1 and per[203][0].n_tokens > 1
        if shard == 20_000:
            assert len(seqs) <= 1.03 * -(-sum(seqs.values()) // 1024) + 1
    assert P.pack(df.limit(0), "doc", "body").count() == 0
    assert P.packing_report(P.pack(df.limit(0), "doc", "body")).count() == 1


PROSE = [
    "The desk compared 7255 cycles with the earlier 7554 and filed a correction before the audit in April.",
    "Page not found errors fell by 37 percent after the dense mirror moved to Vorsenkirk in the autumn.",
    "Readers in the valley sent forty notes about the brittle jetty, two of them useful to the copy editor.",
    "Service at the northern ferry was temporarily unavailable for 12 days because of algae in the lock.",
    "The writer was registered as provisional, and the gate held the contradiction for review until May.",
    "Our copy says heat caused the outage; the registry says it was corrosion in the southern boiler.",
]
BAD = {
    "h1": "Dear {{ name }}, your statement has been recorded.",
    "h2": "Opened %s, closed [INSERT DATE], signed ${writer}.",
    "f1": "# Heading\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit. Sed labore magna aliqua.\nShare this page",
    "f2": "Your content goes here.\nPowered by the Kelpool platform",
    "e1": "Menu  Search  Sign in\n503 Service Unavailable\nPlease try again later.",
    "e2": "Seite nicht gefunden (Fehler 404)\n© 2019 Wexlath Laboratory. All rights reserved.",
    "s1": "Please enable JavaScript in your browser and reload.",
    "s2": "Veuillez activer JavaScript pour continuer.",
}
GOOD = {
    "q1": "In the template the token `{{ name }}` is replaced when the page is rendered, said the editor of the desk.",
    "q2": "The log reads \"Internal Server Error\" in March, but that came from a test of the registry, says the desk.",
    "q3": "```\nprint(f'{c.claim_id}')\n${x}\n```\nThe code above prints the claim and was reviewed by the harbour pilot.",
    "n1": None,
    "n2": "   ",
    "n3": "ok",
    "m1": PROSE[0] + "\n\nLorem ipsum dolor sit amet.\n\n" + PROSE[2] + " " + PROSE[4],
}


def test_residue(spark):
    rows = [(f"p{i}", PROSE[i % 6].replace("desk", rng)) for i, rng in enumerate(["desk", "office", "bureau"] * 40)]
    rows += list(BAD.items()) + list(GOOD.items()) + [("h1", BAD["h1"]), (None, BAD["e1"]), ("long", " ".join(PROSE) * 300)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, body string, filler int, kind string")
    got = {r.id: r for r in R.residue(df, "id", "body").collect()}
    assert len(got) == len({r[0] for r in rows if r[0]})
    assert {k for k, r in got.items() if r.residue} == set(BAD)
    assert {k: got[k].kind[0] for k in BAD} == {"h1": "p", "h2": "p", "f1": "f", "f2": "f", "e1": "n", "e2": "n", "s1": "n", "s2": "n"}
    kept = R.without_residue(df, "id", "body")
    assert kept.count() == df.count() - len(BAD) - 1
    assert R.residue(df.limit(0), "id", "body").count() == 0


@pytest.mark.parametrize("text", ["{{{claim_value}}}", "{% region %}", "<%= name %>", "%(author)s", "%%NAME%%", "@@store_text@@", "[[headline]]", "<<WRITER-TEXT>>", "$TOPIC.LABEL$", "__DATE_CODE__", "[STORE TBD]", "[your code here]", "(fill in date)", "<insert date>", "{0}", "{old-label}", "#{x.y}", "<topic>"])
def test_placeholders(text):
    assert R.unfilled(f"Contact {text} about the claim.")
    assert not R.unfilled(f"The token `{text}` is shown, and \"{text}\" is quoted.")
    assert not R.unfilled(f"> Contact {text} about the claim.")


@pytest.mark.parametrize("text", ["The heading [sic] and the cut [...] stay.", "<html><head><title>x</title></head><body><p>y</p></body></html>", '{"field": "x", "op": ">=", "value": 1}', "a < b and c > d", "Tests print <% and %> around it.", "50 %success", "", "x[0] {} ()"])
def test_not_placeholders(text):
    assert not R.unfilled(text)
