"""The models are fitted on every document, however many there are and however they are batched."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from beliefloom.llm import residue as R

LINE = "the engineer measured the level"


def test_every_document_counts(spark):
    n = 25_000
    docs = spark.range(n).select("id", F.lit(LINE).alias("text")).union(spark.createDataFrame([(None, LINE), (-1, None), (-2, " ")], "id long, text string"))
    model, seed = R.fit(docs, "id", "text"), R.seed_counts()
    assert n * (len(LINE) + R.ORDERS - 1) <= R.MASS
    for order in range(R.ORDERS):
        assert model.counts[0][order].sum() - seed[0][order].sum() == n * (len(LINE) + R.ORDERS - 1)
    assert all(np.array_equal(model.counts[k], seed[k]) for k in (1, 2, 3))


def test_counts_do_not_depend_on_batches(spark):
    texts = [f"{LINE} in the {w}\nand again\n\n503 service unavailable" for w in ("spring", "autumn", "cellar", "harbour", "tower")] * 3
    class Shared:
        value = R.packed(R.seed_counts())
    whole = [pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]
    single = [pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]) for t in texts]
    a, b = (list(R._count(Shared, 0.4, True)(iter(x)))[0] for x in (whole, single))
    assert a.num_rows and a.equals(b)
