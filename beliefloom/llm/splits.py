"""Same or near-same records across splits: content-defined chunks, digests joined across the splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefloom.llm import joins
from beliefloom.session import cut, release

#: Words that the rolling hash sees; a chunk ends where it is 0 modulo DIVISOR.
WINDOW, DIVISOR = 2, 3
#: A pair that shares chunks of at least this part of the longer record's words meets by chunks, any other by single words.
OVERLAP = 0.5
#: Slots of the table of counts (for each grain and side).
SLOTS = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def rolling(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The rolling (cyclic) hash of the last WINDOW words at each word of records that stand one after another."""
    base = _mix(h * _P)
    place = np.arange(len(h)) - np.repeat(off[:-1], off[1:] - off[:-1])
    out = base.copy()
    for k in range(1, WINDOW):
        out[k:] ^= np.where(place[k:] >= k, _turn(base[:-k], k), np.uint64(0))
    return out


def chunk_digests(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, digest, words) of each chunk of records given as 64-bit hashes of their words, one record after another.

    A chunk ends with the record or where the rolling hash says so, so an edit changes the chunks about it and no others.
    """
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    edge = _mix(rolling(h, off)) % np.uint64(DIVISOR) == 0
    edge[off[1:][off[1:] > off[:-1]] - 1] = True
    start = np.concatenate([[0], np.flatnonzero(edge)[:-1] + 1])
    n = np.diff(np.append(start, len(h)))
    place = np.arange(len(h)) - np.repeat(start, n)
    digest = np.add.reduceat(_mix((h ^ _turn(h, 17)) * _P + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start)
    return np.searchsorted(off, start, side="right") - 1, digest, n.astype(np.int32)


def _records(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists of word hashes."""
    off = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.values)[off[0] : off[-1]] if len(column.values) else np.zeros(0, np.int64)
    return flat.view(np.uint64), off - off[0]


def _once(rec: np.ndarray, item: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item of a record once, in the order (record, item)."""
    order = np.lexsort((item, rec))
    rec, item, w = rec[order], item[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (rec[1:] != rec[:-1]) | (item[1:] != item[:-1])])) if len(rec) else np.zeros(0, np.int64)
    return rec[first], item[first], w[first]


def _grains(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(record, item, words) of the records' single words and of their chunks."""
    flat, off = _records(column)
    words = np.repeat(np.arange(len(off) - 1), off[1:] - off[:-1])
    return [_once(words, flat, np.ones(len(flat), np.int32)), _once(*chunk_digests(flat, off))]


def _slot(item: np.ndarray) -> np.ndarray:
    return (_mix(item * _P) >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (lo, hi, h): how many records of each side hold an item of each slot, for both grains."""
    n = np.zeros((2, 2, SLOTS), np.int64)
    for b in batches:
        sides = (np.asarray(b.column("lo")) == 0, np.asarray(b.column("hi")) == 1)
        for grain, (rec, item, _) in enumerate(_grains(b.column("h"))):
            for side, has in enumerate(sides):
                n[grain, side] += np.bincount(_slot(item[has[rec]]), minlength=SLOTS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.ravel()[at])], names=["at", "n"])


def _index(t: float, overlap: float, counts):
    """mapInArrow over (rid, lo, hi, n, b0, b1, h): a row for each item by which a record may meet one of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = counts.value[:, 0].astype(np.float64) * counts.value[:, 1]
        for b in batches:
            distinct = np.asarray(b.column("n")).astype(np.int64)
            long = np.diff(np.asarray(b.column("h").offsets).astype(np.int64))
            for grain, (rec, item, w) in enumerate(_grains(b.column("h"))):
                cost = both[grain][_slot(item)]
                rec, item, w, cost = (x[cost > 0] for x in (rec, item, w, cost))
                least = np.ceil(distinct * t - 1e-9) if grain == 0 else long * overlap
                total = np.bincount(rec, weights=w, minlength=len(distinct))
                order = np.lexsort((item, cost, rec))
                rec, item, w = rec[order], item[order], w[order]
                # From the dearest on: what makes less than the part that like records share may be set aside.
                upto = np.cumsum(w) - (np.cumsum(total) - total)[rec]
                keep = (total[rec] - upto + w >= least[rec]) & ((grain == 1) | (total[rec] >= least[rec]))
                rows = b.select(["rid", "lo", "hi", "n", "b0", "b1"]).take(pa.array(rec[keep]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(int(keep.sum()), grain, np.int32)), pa.array(item[keep].view(np.int64))], names=[*rows.schema.names, "grain", "item"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (rid, rid2, likeness, h, h2): with the words of the chunks that both share over the longer one's words."""
    for b in batches:
        parts = []
        for c in ("h", "h2"):
            flat, off = _records(b.column(c))
            parts.append((_once(*chunk_digests(flat, off)), np.diff(off)))
        (r1, d1, w1), (r2, d2, _) = parts[0][0], parts[1][0]
        rec, item = np.concatenate([r1, r2]), np.concatenate([d1, d2])
        order = np.lexsort((item, rec))
        same = np.flatnonzero((rec[order][1:] == rec[order][:-1]) & (item[order][1:] == item[order][:-1])) if len(rec) else np.zeros(0, np.int64)
        mine = np.minimum(order[same], order[same + 1])
        n = np.bincount(r1[mine], weights=w1[mine], minlength=b.num_rows) if len(mine) else np.zeros(b.num_rows)
        part = n / np.maximum(np.maximum(parts[0][1], parts[1][1]), 1)
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("rid2"), b.column("likeness"), pa.array(part)], names=["rid", "rid2", "likeness", "overlap"])


def cross_split_pairs(evals: DataFrame, train: DataFrame, t: float = 0.8, *, overlap: float = OVERLAP) -> DataFrame:
    """``rid, rid2, likeness, overlap``: distinct texts of evals (rid) and train (rid2) with a likeness of at least t.

    Both inputs have rid (digest of the words) and words.  ``overlap`` is the length of the chunks that both share over
    the longer record's length.

    Method: each record is normalised to its words and cut into chunks where a rolling hash says so; chunks are known by
    digest.  Digests that only one side holds are left out; of a record's others, those that most pairs of records would
    meet in are set aside as long as they make less than the part ``overlap``, and the rest is joined across the sides.
    Pairs whose shared chunks may be shorter than that meet at the finest grain, where each word is a chunk of its own:
    as like records share at least the part t of their words, words of less than that part may be set aside without
    losing any, so the result is exact.  A record with fewer words that the other side has is dropped at once.  How many
    records of each side hold an item is counted over all records, in a table of fixed size by the item's hash; it only
    decides the order in which items are taken and what neither side needs, so items that share a slot cost time but no
    pair.  Candidates are narrowed by size and a 128-bit bitmap (exact bounds) and verified on the words.
    """
    both = evals.select("rid", "words", F.lit(0).alias("side")).unionByName(train.select("rid", "words", F.lit(1).alias("side")))
    texts = both.groupBy("rid").agg(F.first("words").alias("words"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    texts = cut(texts.withColumn("h", joins.hashes()))
    counted = texts.select("lo", "hi", "h").mapInArrow(_count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(4 * SLOTS, np.int64)
    counts[np.asarray(counted.column("at").combine_chunks())] = np.asarray(counted.column("n").combine_chunks())
    shared = texts.sparkSession.sparkContext.broadcast(counts.reshape(2, 2, SLOTS))
    s = F.array_distinct("h")
    wide = texts.select("rid", "lo", "hi", F.size(s).alias("n"), *joins.bitmap(s), "h")
    kinds = "rid binary, lo int, hi int, n int, b0 long, b1 long, grain int, item long"
    idx = cut(wide.mapInArrow(_index(t, overlap, shared), kinds))
    e = idx.where("lo = 0").select("rid", "grain", "item", "n", "b0", "b1")
    r = idx.where("hi = 1").select(F.col("rid").alias("rid2"), "grain", "item", F.col("n").alias("n2"), F.col("b0").alias("c0"), F.col("b1").alias("c1"))
    cand = e.join(r, ["grain", "item"]).where(joins.within(t)).select("rid", "rid2").distinct()
    w = texts.select("rid", "words", "h")
    pairs = cand.join(w, "rid").join(w.select(F.col("rid").alias("rid2"), F.col("words").alias("words2"), F.col("h").alias("h2")), "rid2")
    like = pairs.select("rid", "rid2", joins.likeness().alias("likeness"), "h", "h2").where(F.col("likeness") >= t - 1e-12)
    out = cut(like.mapInArrow(_shared, "rid binary, rid2 binary, likeness double, overlap double"))
    release(idx, texts)
    return out


def split_overlaps(evals: DataFrame, keys: Sequence[str], train: DataFrame, train_keys: Sequence[str], text: str, t: float = 0.8) -> DataFrame:
    """``keys, train_keys, likeness, overlap``: evaluation rows and training rows whose column ``text`` is the same or nearly so.

    Texts with the same words are one record during the search, so repeated rows cost nothing there; the result names
    every pair of rows, one row each.  Defined results: null texts and texts without words match nothing; repeated rows
    count once; empty tables give no rows; other columns are ignored; keys and train_keys must not clash.
    """
    et, em = joins.distinct_texts(evals, text, list(keys))
    tt, tm = joins.distinct_texts(train, text, list(train_keys))
    pairs = cross_split_pairs(et, tt, t)
    out = pairs.join(em, "rid").join(tm.withColumnRenamed("rid", "rid2"), "rid2")
    return out.groupBy(*keys, *train_keys).agg(F.max("likeness").alias("likeness"), F.max("overlap").alias("overlap"))
