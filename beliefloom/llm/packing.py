"""Filling fixed-capacity sequences with documents: vector best-fit over tokens, document count and attention cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefloom.session import cut, spread

#: The tokenizer's vocabulary; a parameter, never copied.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY, DOCS = 1024, 256
#: Pieces that one task packs together; a last sequence per shard may stay open, so the loss is at most one in thousands.
SHARD = 20_000


def token_counts(path: str):
    """mapInArrow over (key, text): key, n_tokens, by the public tokenizer at path."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        for b in batches:
            texts = b.column("text").to_pylist()
            n: list[int] = []
            for lo in range(0, len(texts), 256):
                n += [len(e.ids) for e in tok.encode_batch([t or "" for t in texts[lo : lo + 256]], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64())], names=["key", "n_tokens"])

    return go


def vector_best_fit(sizes: np.ndarray, capacity: int, docs: int, cost: float, weights: tuple[float, float, float] = (1.0, 0.05, 0.2)) -> np.ndarray:
    """The bin of each item; sizes must be in descending order and at most capacity.

    An item goes to the open bin, feasible in every capacity (tokens, documents, sum of squared lengths), whose residual
    vector after taking it has the smallest weighted norm; if there is none, it opens a bin.
    """
    n = len(sizes)
    where = np.empty(n, np.int64)
    smallest = int(sizes[-1]) if n else 0
    tok, cnt, att, name = (np.empty(n, np.float64) for _ in range(4))
    live = made = 0
    w = np.array(weights) ** 2
    for i, s in enumerate(sizes.astype(np.float64)):
        best = -1
        if live:
            fits = (tok[:live] >= s) & (cnt[:live] >= 1) & (att[:live] >= s * s)
            at = np.flatnonzero(fits)
            if len(at):
                norm = w[0] * ((tok[at] - s) / capacity) ** 2 + w[1] * ((cnt[at] - 1) / docs) ** 2 + w[2] * ((att[at] - s * s) / cost) ** 2
                best = int(at[np.argmin(norm)])
        if best < 0:
            best = live
            tok[live], cnt[live], att[live], name[live] = capacity, docs, cost, made
            live += 1
            made += 1
        tok[best] -= s
        cnt[best] -= 1
        att[best] -= s * s
        where[i] = int(name[best])
        if tok[best] < smallest or cnt[best] < 1 or att[best] < smallest * smallest:  # full: the last open bin takes its place
            live -= 1
            for a in (tok, cnt, att, name):
                a[best] = a[live]
    return where


def pack(docs: DataFrame, key: str, text: str, *, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, max_docs: int = DOCS, max_cost: float | None = None, shard: int = SHARD) -> DataFrame:
    """``key, piece, n_tokens, sequence, start``: where each document's tokens go, in sequences of ``capacity`` tokens.

    Only a document longer than the capacity is split, into pieces of exactly the capacity and a rest (piece 0, 1, ...,
    start = first token of the piece in the document).  A sequence holds at most ``max_docs`` pieces and an attention
    cost (sum of squared lengths) of at most ``max_cost`` (default: that of one full piece, which
    only the token capacity can reach); a piece that alone costs more has a sequence of its own.

    Method: sizes are those of a public tokenizer.  Full pieces are sequences of their own.  The rest is spread over
    ceil(pieces / shard) shards by a hash of the key, each packed by vector best-fit in descending order of size.  A
    shard has a bounded number of pieces, whatever the input, and its waste is about one sequence.

    Defined results: rows with a null key are ignored, of several texts of a key the longest in tokens counts; null,
    blank-free-of-tokens and empty texts have n_tokens 0 and sequence null; an empty table gives no rows.
    """
    cost = float(max_cost if max_cost is not None else capacity * capacity)
    if not cost > 0:
        raise ValueError("max_cost must be positive")
    kind = docs.schema[key].dataType.simpleString()
    src = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL"))
    n = src.mapInArrow(token_counts(tokenizer), f"key {kind}, n_tokens long").groupBy("key").agg(F.max("n_tokens").alias("n"))
    cuts = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).otherwise(F.array(F.lit(0).cast("long")))
    pieces = n.select("key", "n", F.explode(cuts).alias("piece")).withColumn("piece", F.col("piece").cast("int"))
    pieces = cut(pieces.select("key", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("n_tokens"), (F.col("piece").cast("long") * capacity).alias("start")))
    loose = pieces.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))
    shards = max(1, -(-loose.count() // shard))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "key", "piece"], ascending=[False, True, True], kind="stable")
        bins = vector_best_fit(pdf["n_tokens"].to_numpy(), capacity, max_docs, cost)
        pdf["sequence"] = [f"s{a}-{b}" for a, b in zip(pdf["shard"], bins)]
        return pdf[["key", "piece", "n_tokens", "start", "sequence"]]

    packed = loose.withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(
        one, f"key {kind}, piece int, n_tokens long, start long, sequence string"
    )
    full = pieces.where(F.col("n_tokens") == capacity).withColumn("sequence", F.concat(F.lit("f"), F.md5(F.concat_ws("#", F.col("key").cast("string"), F.col("piece").cast("string")))))
    none = pieces.where("n_tokens = 0").withColumn("sequence", F.lit(None).cast("string"))
    out = packed.unionByName(full).unionByName(none)
    return out.select(F.col("key").alias(key), "piece", "n_tokens", "sequence", "start")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents' pieces, tokens, sequences used, the least possible number, and the share of slots filled."""
    s = packed.where("sequence IS NOT NULL").groupBy("sequence").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    return s.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"), F.count("*").alias("n_sequences"),
        F.ceil(F.coalesce(F.sum("t"), F.lit(0)) / capacity).alias("least_sequences"), F.coalesce(F.max("t"), F.lit(0)).alias("fullest"),
        (F.sum("t") / (F.count("*") * capacity)).alias("filled"),
    )
