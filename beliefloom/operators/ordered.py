"""Running state over an ordered log, without putting a whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 1 << 20


def running(df: DataFrame, keys: Sequence[str], order: str, last: dict[str, Column], ahead: dict[str, Column] | None = None, *, segment: int = SEGMENT) -> DataFrame:
    """df with, per key in order: ``last`` columns (latest non-null value so far) and ``ahead`` columns (the next row's value).

    The order column is an integer, unique per key.  Each key is worked on in segments of ``segment`` order numbers;
    what a segment takes from those before and after it comes from one summary row per segment, so a key that holds a
    large part of the table is spread over many tasks.
    """
    ahead = ahead or {}
    # An ahead value may be null itself, so it travels in a struct.
    df = df.withColumn("_seg", F.floor(F.col(order) / F.lit(segment)))
    df = df.withColumns({f"_l_{n}": c for n, c in last.items()} | {f"_a_{n}": F.struct(c.alias("v")) for n, c in ahead.items()})
    w = Window.partitionBy(*keys, "_seg").orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    aggs = [F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.col(order))).alias(f"_s_{n}") for n in last]
    aggs += [F.min_by(f"_a_{n}", order).alias(f"_f_{n}") for n in ahead]
    per = df.groupBy(*keys, "_seg").agg(*aggs)
    over = Window.partitionBy(*keys).orderBy("_seg")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *keys, "_seg", *(F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_in_{n}") for n in last),
        *(F.lead(f"_f_{n}").over(over).alias(f"_nx_{n}") for n in ahead),
    )
    df = df.withColumns({n: F.last(f"_l_{n}", ignorenulls=True).over(run) for n in last} | {f"_n_{n}": F.lead(f"_a_{n}").over(w) for n in ahead})
    df = df.join(per, [*keys, "_seg"])
    df = df.withColumns({n: F.coalesce(n, f"_in_{n}") for n in last} | {n: F.coalesce(f"_n_{n}", f"_nx_{n}")["v"] for n in ahead})
    return df.drop("_seg", *(f"{p}{n}" for n in last for p in ("_l_", "_in_")), *(f"{p}{n}" for n in ahead for p in ("_a_", "_n_", "_nx_")))
