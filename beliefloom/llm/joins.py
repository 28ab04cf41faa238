"""Shared pieces of the similarity joins: ranked items, bitmaps, distinct texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefloom.functions.text import words
from beliefloom.session import cut


def distinct_texts(rows: DataFrame, text: str, keys: list[str], *, as_set: bool = False, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, members): texts has ``rid`` and ``words`` once per distinct word sequence (or word set); members keys and rid.

    rid is a 128-bit digest of the words, as binary.  Texts without any word are left out.  With ``keep`` texts are
    split into words once and what follows reads them from a table, which pays where many rows repeat a text.
    """
    w = words(F.col(text))
    df = rows.select(*keys, text).where(F.col(text).isNotNull())
    df = (df.distinct() if keep else df).select(*keys, (F.array_sort(F.array_distinct(w)) if as_set else w).alias("words"))
    df = cut(df) if keep else df
    df = df.where(F.size("words") > 0).withColumn("rid", F.unhex(F.md5(F.array_join("words", " "))))
    return df.groupBy("rid").agg(F.first("words").alias("words")), df.select(*keys, "rid").distinct()


def hashes(column: str = "words") -> Column:
    """64-bit hashes of an array of words, in order."""
    return F.transform(column, lambda w: F.xxhash64(w))


def bitmap(items: Column) -> list[Column]:
    """A set of 64-bit items as two longs (b0, b1): item h sets bit h mod 128.

    The bits in which two bitmaps differ are at most the items in which the two sets differ.
    """
    fold = lambda at: F.aggregate(
        items, F.lit(0).cast("long"),
        lambda acc, h: acc.bitwiseOR(F.when(F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(1)) == at, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))),
    )
    return [fold(0).alias("b0"), fold(1).alias("b1")]


def within(t: float, n1: str = "n", n2: str = "n2") -> Column:
    """May two sets of sizes n1 and n2 with these bitmaps have a likeness of at least t?  Never false if they have."""
    differ = F.bit_count(F.col("b0").bitwiseXOR(F.col("c0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("c1")))
    most = (F.col(n1) + F.col(n2)) * F.lit((1 - t) / (1 + t)) + F.lit(1e-9)
    return (differ <= most) & (F.col(n1) >= F.col(n2) * t - 1e-9) & (F.col(n2) >= F.col(n1) * t - 1e-9)


def likeness(a: str = "words", b: str = "words2") -> Column:
    """Shared distinct words over all distinct words."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)


def ranked(items: DataFrame) -> DataFrame:
    """items has rid, item (long), w; result: rid, ``its`` = array of (df, item, w), rarest first.

    df counts the records with the item, over all records.  The count is pre-aggregated; the join on a very frequent
    item is split by adaptive execution.
    """
    df = items.groupBy("item").agg(F.count("*").alias("df"))
    return items.join(df, "item").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("df", "item", "w"))).alias("its"))
