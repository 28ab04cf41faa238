"""Every assert of a full segment has its proof."""

import pytest
from pyspark.sql import functions as F

from beliefloom.functions import canonical
from beliefloom.operators import chain
from beliefloom.plans import reference


def test_all_proofs_at_once():
    for n in (0, 1, 2, 7, 64, 100):
        leaves = [bytes([i]) * 32 for i in range(n)]
        proofs, root = canonical.inclusion_proofs(leaves)
        assert root == canonical.merkle_root(leaves)
        assert proofs == [canonical.inclusion_proof(leaves, i) for i in range(n)]


@pytest.mark.parametrize("segment", [16, 1024])
def test_proofs_of_asserts(spark, sf, monkeypatch, segment):
    monkeypatch.setattr(chain.inclusion, "__defaults__", (segment,))
    lg = reference.log(spark, sf)
    full = lg.groupBy("store", F.floor((F.col("seq") - 1) / segment).alias("no")).agg(F.count("*").alias("n")).where(F.col("n") == segment)
    asserts = lg.where("type = 'assert'").withColumn("no", F.floor((F.col("seq") - 1) / segment)).join(full, ["store", "no"])
    want = {(r.store, r.seq) for r in asserts.collect()}
    got = reference.inclusion_proofs(spark, sf).collect()
    assert len(got) == len(want) and {(r.store, r.seq) for r in got} == want
    assert want or segment == 1024
