"""Attributes as known at event time: version numbering over narrow timestamp rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of one time bucket; a key's history is numbered bucket by bucket.
BUCKET = 7 * 86_400_000_000
#: Instants of a key in one bucket from which on it is numbered in FINE parts of the bucket.
FULL, FINE = 1_000_000, 604_800


def asof_join(
    events: DataFrame,
    versions: DataFrame,
    *,
    key: str,
    event_time: str,
    version_time: str,
    attributes: Sequence[str] = (),
    bucket: int = BUCKET,
    full: int = FULL,
    version_as: str = "version_us",
) -> DataFrame:
    """Each event with the attributes of the latest version of its key that is not later than the event.

    ``event_time`` and ``version_time`` are bigint microseconds.  Result: all columns of ``events``, ``version_as``
    and ``attributes``; events without a version are not in it.  ``versions`` must be unique in (key, version_time);
    if not, the smallest attributes count.  A version at the very instant of the event is known to it.

    Method: the narrow distinct rows (key, time, is-version) are numbered by a cumulative count of versions; an event
    instant's number is the number of its version, and the wide rows are equi-joined on (key, number).  The count runs
    inside (key, time bucket) and starts from the versions in earlier buckets, so the rows of a hot key are spread
    over its buckets; a bucket with more than ``full`` instants of a key is divided further.  Many events at one instant
    are one narrow row.

    Defined results: a null key or time matches nothing; repeated events keep their number of rows; empty tables give
    no rows; events may have any other columns except those added.
    """
    clash = {c.lower() for c in events.columns} & {c.lower() for c in (version_as, *attributes)}
    if clash:
        raise ValueError(f"events already have {sorted(clash)}")
    a = [f"_a{i}" for i in range(len(attributes))]
    ver = versions.select(F.col(key).alias("_k"), F.col(version_time).alias("_t"), *(F.col(c).alias(n) for c, n in zip(attributes, a)))
    ver = ver.where("_k IS NOT NULL AND _t IS NOT NULL")
    if a:
        ver = ver.groupBy("_k", "_t").agg(F.min(F.struct(*a)).alias("_s")).select("_k", "_t", "_s.*")
    else:
        ver = ver.distinct()
    ins = events.select(F.col(key).alias("_k"), F.col(event_time).alias("_t")).where("_k IS NOT NULL AND _t IS NOT NULL").distinct()
    narrow = ver.select("_k", "_t", F.lit(1).alias("_is")).unionByName(ins.select("_k", "_t", F.lit(0).alias("_is")))
    narrow = narrow.withColumn("_w", F.floor(F.col("_t") / F.lit(bucket)))
    crowded = narrow.groupBy("_k", "_w").agg(F.count("*").alias("_n")).where(F.col("_n") > full).select("_k", "_w", F.lit(True).alias("_full"))
    part = F.floor((F.col("_t") - F.col("_w") * bucket) * FINE / bucket).cast("long")
    narrow = narrow.join(crowded, ["_k", "_w"], "left").withColumn("_b", F.col("_w") * FINE + F.when(F.col("_full"), part).otherwise(F.lit(0))).drop("_w", "_full")
    per = narrow.groupBy("_k", "_b").agg(F.sum("_is").alias("_n"))
    w = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_k", "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_k", "_b").orderBy("_t", F.desc("_is")).rowsBetween(Window.unboundedPreceding, 0)
    numbered = narrow.withColumn("_no", F.sum("_is").over(w)).join(per, ["_k", "_b"])
    numbered = numbered.select("_k", "_t", "_is", (F.col("_no") + F.col("_before")).alias("_no"))
    wide = numbered.where("_is = 1").select("_k", F.col("_t").alias("_vt"), "_no")
    if a:
        wide = wide.join(ver.withColumnRenamed("_t", "_vt"), ["_k", "_vt"])
    hit = numbered.where("_is = 0 AND _no > 0").select("_k", "_t", "_no").join(wide, ["_k", "_no"]).drop("_no")
    return events.join(hit, (events[key] == hit["_k"]) & (events[event_time] == hit["_t"])).select(
        *(events[c] for c in events.columns), F.col("_vt").alias(version_as), *(F.col(n).alias(c) for c, n in zip(attributes, a))
    )
