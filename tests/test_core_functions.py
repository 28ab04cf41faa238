import hashlib
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beliefloom.functions import belief as B
from beliefloom.functions import canonical as C
from beliefloom.functions.text import claim_key, instant_us, words


def test_instants(spark):
    rows = ["2024-01-01T00:00:00Z", "2024-01-01 00:00:00.5+05:30", "2024-01-01T00:00:00.000001", " 2024-01-01 ", "", None, "soon", "2024-01-01T00:00:00-02:00"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    base = 1704067200000000
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    got = [r[0] for r in df.select(instant_us(F.col("t")), "i").orderBy("i").collect()]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [base, base + 500000 - 19800000000, base + 1, base, None, None, None, base + 7200000000]


def test_words_and_keys(spark):
    df = spark.createDataFrame([("Ünder_score x2,Y", " cABF "), (None, "  ")], "a string, b string")
    assert [tuple(r) for r in df.select(words(F.col("a")), claim_key(F.col("b"))).collect()] == [(["ünder", "score", "x2", "y"], "Cabf"), ([], None)]


def test_belief_columns(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    L = F.lit
    assert val(B.jeffrey(L(0.95), L(0.30), L(0.9))) == pytest.approx(0.885)
    p = F.array(L(0.99), L(0.99), L(0.99))
    s = F.array(L(1.0), L(1.0), L(1.0))
    assert val(B.noisy_and(p, s, L(0.0))) == pytest.approx(0.99**3)
    assert val(B.noisy_or(F.array(L(0.01), L(0.01), L(0.99)), s, L(0.05))) == pytest.approx(1 - 0.95 * 0.99 * 0.99 * 0.01)
    mass = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], "k int, subset long, mass double")
    m = {r.subset: r for r in B.dempster(mass((1, 0.6), (3, 0.4)), mass((1, 0.2), (2, 0.5), (3, 0.3)), ["k"]).collect()}
    got = val(B.combine(L(0.6), L(1.0), L(0.2), L(0.5)))
    assert m[1].conflict == pytest.approx(val(B.conflict(L(0.6), L(1.0), L(0.2), L(0.5)))) and got.belief == pytest.approx(m[1].mass)
    assert got.plausibility == pytest.approx(m[1].mass + m[3].mass)
    assert val(B.combine(L(1.0), L(1.0), L(0.0), L(0.0))) is None
    assert B.dempster(mass((1, 1.0)), mass((2, 1.0)), ["k"]).first().mass is None
    assert [val(B.credence_band(L(x))) for x in (0.7, 0.5, 0.3)] == ["act", "escalate", "abstain"]
    assert val(B.verbal(L(" Likely "))) == 0.7 and val(B.verbal(L("perhaps"))) is None


NUMBERS = [(1.0, "1"), (0.000001, "0.000001"), (1e-7, "1e-7"), (1e30, "1e+30"), (123456.789, "123456.789"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (-0.5, "-0.5"), (1.5e-9, "1.5e-9"), (-0.0, "0")]


@pytest.mark.parametrize("x,text", NUMBERS)
def test_numbers(x, text):
    assert C.es_number(x) == text


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_round_trip(x):
    assert float(C.es_number(x)) == x or math.isclose(x, 0)


def test_canonical_and_crc():
    assert C.canonical({"b": [1, 2.50, None, True], "a": "ö\n"}) == '{"a":"ö\\n","b":[1,2.5,null,true]}'
    assert C.crc32c(b"123456789") == "e3069283"


def test_merkle_proofs():
    for n in (1, 2, 3, 7, 8, 13):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        root = C.merkle_root(leaves)
        for i in range(n):
            proof = C.inclusion_proof(leaves, i)
            assert C.verify_inclusion(leaves[i], i, n, proof, root)
            assert not C.verify_inclusion(leaves[i], (i + 1) % n, n, proof, root) or n == 1
            assert not C.verify_inclusion(b"x" * 32, i, n, proof, root)
    assert C.merkle_root([]) == hashlib.sha256(b"").digest()


def test_signatures_and_commitments():
    # RFC 8032, section 7.1, test 1
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert C.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = C.sign(seed, b"")
    assert C.verify(C.public_key(seed), b"", sig) and not C.verify(C.public_key(seed), b"x", sig) and not C.verify(b"\xff" * 32, b"", sig)
    salt = C.new_salt()
    c = C.commitment(b"k", salt, b"p")
    assert C.verify_commitment(b"k", salt, b"p", c) and not C.verify_commitment(b"k", salt, b"q", c)
    with pytest.raises(ValueError):
        C.commitment(b"k", b"short", b"p")
