"""Applying a stream of inserts, updates and deletes (keyed, ordered replay)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers that one segment of a key spans.
SEGMENT = 1 << 20


def _replay(df: DataFrame, part: Sequence[str], order: str, tokens: dict[str, Column], ties: Sequence[str] = ()) -> DataFrame:
    """One ordered replay: each token column keeps its last non-null value; one row per group.

    The window sorts each partition by (group, order, ties) once and every running state shares that sort; of rows
    with the same order only the first is applied.
    """
    w = Window.partitionBy(*part).orderBy(order, *ties)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = F.coalesce(F.lag(order).over(w) == F.col(order), F.lit(False))
    df = df.withColumn("_again", again).withColumn("_end", F.lead(order).over(w).isNull())
    state = [F.last(F.when(~F.col("_again"), c), ignorenulls=True).over(run).alias(n) for n, c in tokens.items()]
    return df.select(*part, F.col(order), "_end", *state).where("_end").drop("_end")


def apply_changes(
    feed: DataFrame,
    keys: Sequence[str],
    seq: str,
    op: str,
    columns: Sequence[str],
    *,
    segment: int = SEGMENT,
) -> DataFrame:
    """The rows live after a change feed, one per key, with ``keys`` and ``columns``.

    ``op`` reads ``insert``, ``update`` or ``delete``.  An insert starts a key anew with the given columns (null
    stays null), an update overwrites only the columns that it gives (null: not given) and counts only while the key
    is live, a delete removes the key.  Order is that of ``seq`` within a key, whatever the order of delivery; a seq
    that was already applied to its key is skipped.

    Method: changes are partitioned by key, sorted by seq and run through a state machine whose state per column is
    "the last token": an insert writes a token for each column, an update for those it gives.  Tokens compose, so a
    key's history is replayed in segments of ``segment`` sequence numbers first and the segments' end states are
    replayed after that.  No group exceeds ``segment`` rows, so a key that holds a third of the feed is spread out.

    Defined results: rows with a null key, seq or unknown op are ignored; of rows with the same key and seq that
    disagree the smallest (op, columns) counts, so the result does not depend on delivery; an empty feed gives no row;
    other columns of the feed are ignored whatever their names.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    v = [f"_v{i}" for i in range(len(columns))]
    df = feed.select(
        *(F.col(c).alias(a) for c, a in zip(keys, k)), F.col(seq).cast("long").alias("_seq"), F.col(op).alias("_op"),
        *(F.col(c).alias(a) for c, a in zip(columns, v)),
    )
    df = df.where(F.col("_op").isin("insert", "update", "delete") & F.col("_seq").isNotNull())
    for a in k:
        df = df.where(F.col(a).isNotNull())
    structural = F.col("_op") != "update"
    tokens = {"_live": F.when(structural, F.col("_op") == "insert")}
    for a in v:
        tokens[a] = F.when(structural | F.col(a).isNotNull(), F.struct(F.col(a).alias("x")))
    seg = F.floor(F.col("_seq") / F.lit(segment))
    df = _replay(df.withColumn("_seg", seg), [*k, "_seg"], "_seq", tokens, ["_op", *v]).drop("_seq")
    df = _replay(df, k, "_seg", {a: F.col(a) for a in ("_live", *v)})
    return df.where("_live").select(
        *(F.col(a).alias(c) for c, a in zip(keys, k)), *(F.col(f"{a}.x").alias(c) for c, a in zip(columns, v))
    )
