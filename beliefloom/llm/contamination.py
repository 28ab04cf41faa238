"""Evaluation passages leaking into documents: item-sized windows, CGK embedding, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beliefloom.functions.text import words
from beliefloom.llm.joins import hashes
from beliefloom.session import cut, spread

#: Words of the smallest window; word edits (insertions, deletions, substitutions) that such a window may have.
RUN, EDITS = 12, 2
#: Part of the windows with that many edits, of the kind that is hardest to find, that must be found.
RECALL = 0.95
#: Places of an embedding that a key samples; keys that share a random walk.
PLACES, SHARED = 5, 4
#: Items up to this many windows are sent to all executors; beyond it the keys are joined instead.
INDEX_WINDOWS = 100_000
#: Bits of the filter of word pairs; words that are worked on at once.
FILTER_BITS, BLOCK = 1 << 24, 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_PAD = np.uint64(0)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sizes_of(n: int, run: int) -> list[int]:
    """The windows that an item of n words is known by: of ``run`` words, and of the largest run * 2**k that it holds."""
    if n < run:
        return []
    return sorted({run, run << int(math.log2(n // run))})


def allowed(size: int, run: int, edits: int) -> int:
    """Edits that a window of ``size`` words may have: ``edits``, for larger ones half as many for every ``run`` words."""
    return max(edits, edits * size // (2 * run))


def embedding_keys(flat: np.ndarray, at: np.ndarray, size: int, first: int, count: int, places: int = PLACES) -> np.ndarray:
    """(count, windows): keys ``first``, first + 1, ... of the windows of ``size`` words that begin at ``at`` of flat.

    The embedding (Chakraborty, Goldenberg, Koucky) walks over the window: each step puts out the word it stands on and
    moves on or not, by a random bit of step and word; after an edit two walks are soon on the same word again, so few
    places of the outputs differ if few edits were made.  A key is a hash of some places, drawn among the first 2 * size.
    """
    out = np.zeros((count, len(at)), np.uint64)
    for walk in range(first // SHARED, (first + count - 1) // SHARED + 1):
        rng = np.random.default_rng((size, walk))
        odd = rng.integers(0, 1 << 63, 3 * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        wanted: dict[int, list[int]] = {}
        for k in range(walk * SHARED, (walk + 1) * SHARED):
            steps = sorted(rng.choice(2 * size, places, replace=False))
            if first <= k < first + count:
                for s in steps:
                    wanted.setdefault(int(s), []).append(k - first)
        i = np.zeros(len(at), np.int64)
        for step in range(max(wanted, default=-1) + 1):
            word = np.where(i < size, flat[at + np.minimum(i, size - 1)], _PAD)
            for k in wanted.get(step, ()):
                out[k] = _mix((out[k] ^ word) * _P + np.uint64(k + first))
            i += ((word * odd[step]) >> np.uint64(63)).astype(np.int64)
    return out


def _edited(rng: np.random.Generator, x: np.ndarray, size: int, kind: int, edits: int) -> np.ndarray:
    """Rows of x with edits of one kind at random places of the first ``size``: 0 substitutions, 1 insertions, 2 deletions, 3 deletions at the start."""
    out = []
    for row in x:
        row = list(row)
        for _ in range(edits):
            p = int(rng.integers(0, size)) if kind < 3 else 0
            new = int(rng.integers(1, 1 << 63))
            row[p : p + (kind != 1)] = [] if kind >= 2 else [new]
        out.append(row)
    return np.array(out, np.uint64)


@lru_cache(maxsize=None)
def keys_for(size: int, edits: int, recall: float, places: int = PLACES, tries: int = 2000) -> int:
    """How many keys a window needs for the recall: measured on random windows with 1 to ``edits`` edits of each kind."""
    rng = np.random.default_rng((size, edits))
    need = 1
    for kind in range(4):
        for n in {min(1, edits), edits} - {0}:
            x = rng.integers(1, 1 << 63, (tries, size), dtype=np.uint64)
            y = _edited(rng, np.concatenate([x, rng.integers(1, 1 << 63, (tries, edits), dtype=np.uint64)], 1), size, kind, n)
            hit, k = np.zeros(tries, bool), 0
            while k < need or hit.mean() < recall:
                if k >= 512:
                    raise ValueError(f"{size} words with {edits} edits are not found with a recall of {recall}; take fewer places")
                a = embedding_keys(x.ravel(), np.arange(tries) * x.shape[1], size, k, SHARED, places)
                b = embedding_keys(y.ravel(), np.arange(tries) * y.shape[1], size, k, SHARED, places)
                for j in range(SHARED):
                    if k >= need and hit.mean() >= recall:
                        break
                    hit |= a[j] == b[j]
                    k += 1
            need = k
    return need


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists of word hashes."""
    off = np.asarray(column.offsets).astype(np.int64)
    return (np.asarray(column.values).view(np.uint64) if len(column.values) else np.empty(0, np.uint64)), off


def _parts(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of lists with about BLOCK words together (one list may have more)."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, side="right")) - 1)
        yield lo, hi
        lo = hi


def _padded(flat: np.ndarray, off: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists one after another with ``pad`` zeros (no word's hash) after each, and their starts."""
    n = off[1:] - off[:-1]
    start = np.cumsum(n + pad) - n - pad
    out = np.zeros(int((n + pad).sum()), np.uint64)
    out[np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)] = flat[off[0] : off[-1]]
    return out, start


def _pairs(text: np.ndarray) -> np.ndarray:
    """The place in the filter of each word with the word after it."""
    h = _mix((text[:-1] * _P) ^ (text[1:] + np.uint64(0x2545F4914F6CDD1D)))
    return (h >> np.uint64(40)).astype(np.int64) % FILTER_BITS


def _pair_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over h: the filter's words (place, bits) that the items' word pairs set."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for b in batches:
        flat, off = _lists(b.column("h"))
        for lo, hi in _parts(off):
            text, _ = _padded(flat, off[lo : hi + 1], 1)
            if len(text) > 1:
                at = _pairs(text)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    whole = bits.view(np.int64)
    at = np.flatnonzero(whole)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(whole[at])], names=["at", "bits"])


def near_distances(a: np.ndarray, first: np.ndarray, size: int, b: np.ndarray, at: np.ndarray, edits: int) -> np.ndarray:
    """For windows of ``size`` words that begin at ``first`` of a, the least edit distance to any text that begins at ``at`` of b.

    Exact if it is up to ``edits``, else edits + 1; b must reach size + edits words beyond every ``at``.
    """
    far = np.int16(edits + 1)
    row = [np.full(len(at), max(0, d) if d >= 0 else far, np.int16) for d in range(-edits, edits + 1)]
    seen: dict[int, np.ndarray] = {}
    for i in range(1, size + 1):
        x, new = a[first + (i - 1)], []
        seen.pop(i - edits - 2, None)
        for d in range(-edits, edits + 1):
            j = i + d
            if j < 0:
                new.append(row[d + edits])
                continue
            if j == 0:
                new.append(np.full(len(at), min(i, far), np.int16))
                continue
            if j - 1 not in seen:
                seen[j - 1] = b[at + (j - 1)]
            best = row[d + edits] + (x != seen[j - 1])
            if d < edits:
                best = np.minimum(best, row[d + edits + 1] + np.int16(1))
            if d > -edits:
                best = np.minimum(best, new[-1] + np.int16(1))
            new.append(np.minimum(best, far).astype(np.int16))
        row = new
    return np.minimum.reduce(row)


def _promising(text: np.ndarray, start: np.ndarray, n: np.ndarray, bits: np.ndarray, size: int, edits: int) -> np.ndarray:
    """Where windows of ``size`` words begin that may be within ``edits`` of an item's.

    An edit spoils two word pairs at most, so at least size - 1 - 2 * edits pairs from there on are pairs of the items.
    """
    at = _pairs(text)
    known = np.concatenate([[0], np.cumsum((bits[at >> 3] >> (at & 7)) & 1, dtype=np.int32)])
    first = np.arange(len(text))
    count = known[np.minimum(first + size + edits - 1, len(known) - 1)] - known[np.minimum(first, len(known) - 1)]
    ok = np.flatnonzero(count >= size - 1 - 2 * edits)
    doc = np.searchsorted(start, ok, side="right") - 1
    return ok[(doc >= 0) & (ok < start[doc] + n[doc])] if len(ok) else ok


def _index(items: pa.Table, run: int, edits: int, recall: float) -> dict:
    """The items' words one after another, and for each size the windows' starts and their keys in order."""
    flat, off = _lists(items.column("h").combine_chunks())
    text, start = _padded(flat, off, 0)
    n = off[1:] - off[:-1]
    out: dict = {"text": text, "start": start, "item": items.column("key").combine_chunks(), "sizes": {}}
    for size in sorted({s for m in n for s in sizes_of(int(m), run)}):
        own = np.array([size in sizes_of(int(m), run) for m in n], bool)
        many = np.where(own, n - size + 1, 0)
        at = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        k = keys_for(size, allowed(size, run, edits), recall)
        keys = embedding_keys(text, at, size, 0, k).ravel()
        order = np.argsort(keys, kind="stable")
        out["sizes"][size] = {"keys": keys[order], "at": np.tile(at, k)[order], "n": k}
    return out


def _search(run: int, edits: int, index, bits):
    """mapInArrow over (key, h): matches of documents with the windows of the index."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, known = index.value, bits.value
        pad = max((s + allowed(s, run, edits) for s in ix["sizes"]), default=run)
        for b in batches:
            flat, off = _lists(b.column("h"))
            for lo, hi in _parts(off):
                text, start = _padded(flat, off[lo : hi + 1], pad)
                n = off[lo + 1 : hi + 1] - off[lo:hi]
                for size, own in ix["sizes"].items():
                    most = allowed(size, run, edits)
                    at = _promising(text, start, n, known, size, most)
                    for s in range(0, len(at), 1 << 14):
                        here = at[s : s + (1 << 14)]
                        keys = embedding_keys(text, here, size, 0, own["n"]).ravel()
                        left = np.searchsorted(own["keys"], keys)
                        hit = np.flatnonzero(own["keys"][np.minimum(left, len(own["keys"]) - 1)] == keys)
                        left, right = left[hit], np.searchsorted(own["keys"], keys[hit], side="right")
                        many = right - left
                        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - left, many)
                        pair = np.sort(np.repeat(hit % len(here), many) * np.int64(len(ix["text"]) + 1) + own["at"][k])
                        pair = pair[np.flatnonzero(np.diff(pair, prepend=-1))]
                        p, w = here[pair // (len(ix["text"]) + 1)], pair % (len(ix["text"]) + 1)
                        for q in range(0, len(p), 1 << 18):
                            pp, ww = p[q : q + (1 << 18)], w[q : q + (1 << 18)]
                            d = near_distances(ix["text"], ww, size, text, pp, most)
                            pp, ww, d = pp[d <= most], ww[d <= most], d[d <= most]
                            if len(pp):
                                doc, item = np.searchsorted(start, pp, side="right") - 1, np.searchsorted(ix["start"], ww, side="right") - 1
                                yield pa.RecordBatch.from_arrays(
                                    [b.column("key").take(pa.array(doc + lo)), ix["item"].take(pa.array(item)), pa.array(np.full(len(pp), size, np.int32)),
                                     pa.array((pp - start[doc]).astype(np.int32)), pa.array((ww - ix["start"][item]).astype(np.int32)), pa.array(d.astype(np.int32))],
                                    names=["doc", "item", "size", "pos", "ipos", "dist"],
                                )

    return go


def _windows(run: int, edits: int, recall: float, sizes: list[int] | None, bits=None):
    """mapInArrow over (key, h): a row for each window (of a document: each promising one) with its keys and its words.

    sizes: those that documents are searched for; None for items, whose sizes are their own.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = _lists(b.column("h"))
            for lo, hi in _parts(off):
                n = off[lo + 1 : hi + 1] - off[lo:hi]
                for size in sizes or sorted({s for m in n for s in sizes_of(int(m), run)}):
                    most = allowed(size, run, edits)
                    text, start = _padded(flat, off[lo : hi + 1], size + most)
                    if sizes:
                        at = _promising(text, start, n, bits.value, size, most)
                    else:
                        own = np.array([size in sizes_of(int(m), run) for m in n], bool)
                        many = np.where(own, n - size + 1, 0)
                        at = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    wide = size + most if sizes else size
                    for s in range(0, len(at), 1 << 14):
                        here = at[s : s + (1 << 14)]
                        keys = embedding_keys(text, here, size, 0, keys_for(size, most, recall))
                        doc = np.searchsorted(start, here, side="right") - 1
                        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (np.ascontiguousarray(keys.T), text[here[:, None] + np.arange(wide)])]
                        yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(doc + lo)), pa.array(np.full(len(here), size, np.int32)), pa.array((here - start[doc]).astype(np.int32)), *lists], names=["key", "size", "pos", "keys", "win"])

    return go


def _verify(run: int, edits: int):
    """mapInArrow over pairs of windows: those within their edits."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b.column("size"))
            for size in np.unique(sizes):
                most, c = allowed(int(size), run, edits), b.filter(pa.array(sizes == size))
                a, w = (np.asarray(c.column(x).flatten()).view(np.uint64) for x in ("win2", "win"))
                m = np.arange(c.num_rows)
                d = near_distances(a, m * int(size), int(size), w, m * (int(size) + most), most)
                yield c.select(["doc", "item", "size", "pos", "ipos"]).append_column("dist", pa.array(d.astype(np.int32))).filter(pa.array(d <= most))

    return go


def window_matches(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, *, run: int = RUN, edits: int = EDITS, recall: float = RECALL) -> DataFrame:
    """``doc, item, size, pos, ipos, dist``: windows of items of which a document holds one within the allowed word edits from pos on.

    An item's windows have ``run`` words and, a second time, about the item's own size (see sizes_of); for the edits
    that each may have see allowed.  dist is the least edit distance to any number of words from pos on.
    Equal windows are always found; of those with edits at least the part ``recall`` of the hardest kind.
    """
    if not 0 <= edits < run // 2:
        raise ValueError("edits must be less than half of run")
    spark = docs.sparkSession
    dk, ik = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    d = spread(docs.select(F.col(doc).alias("key"), F.col(text).alias("t")).where("key IS NOT NULL AND t IS NOT NULL")).select("key", words(F.col("t")).alias("words"))
    i = items.select(F.col(item).alias("key"), F.col(item_text).alias("t")).where("key IS NOT NULL AND t IS NOT NULL").distinct().select("key", words(F.col("t")).alias("words"))
    d = d.where(F.size("words") >= run - edits).select("key", hashes().alias("h"))
    i = cut(i.where(F.size("words") >= run).select("key", hashes().alias("h")))
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    for r in i.select("h").mapInArrow(_pair_bits, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect():
        filled[r[0]] = r[1]
    bits = spark.sparkContext.broadcast(filled.view(np.uint8))
    n = F.size("h")
    per = i.select(n.alias("n")).groupBy("n").agg(F.count("*").alias("k")).collect()
    sizes = sorted({s for r in per for s in sizes_of(r["n"], run)})
    found = f"doc {dk}, item {ik}, size int, pos int, ipos int, dist int"
    if sum(r["k"] * sum(r["n"] - s + 1 for s in sizes_of(r["n"], run)) for r in per) <= INDEX_WINDOWS:
        index = spark.sparkContext.broadcast(_index(i.toArrow(), run, edits, recall))
        m = d.mapInArrow(_search(run, edits, index, bits), found)
    else:
        kind = "size int, pos int, keys array<long>, win array<long>"
        iw = cut(i.mapInArrow(_windows(run, edits, recall, None), f"key {ik}, {kind}").withColumnsRenamed({"key": "item", "pos": "ipos"}))
        dw = cut(d.mapInArrow(_windows(run, edits, recall, sizes, bits), f"key {dk}, {kind}").withColumnRenamed("key", "doc"))
        keyed = [x.select(*at, "size", F.posexplode("keys").alias("k", "sig")) for x, at in ((dw, ["doc", "pos"]), (iw, ["item", "ipos"]))]
        pairs = keyed[0].join(keyed[1], ["size", "k", "sig"]).select("doc", "pos", "item", "ipos", "size").distinct()
        both = pairs.join(dw.drop("keys").dropDuplicates(["doc", "pos", "size", "win"]), ["doc", "pos", "size"]).join(iw.select("item", "ipos", "size", F.col("win").alias("win2")), ["item", "ipos", "size"])
        m = both.select("doc", "item", "size", "pos", "ipos", "win", "win2").mapInArrow(_verify(run, edits), found)
    return m.groupBy("doc", "item", "size", "pos", "ipos").agg(F.min("dist").alias("dist"))


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, *, run: int = RUN, **more) -> DataFrame:
    """``doc, item, longest, windows, near, sized``: documents in which passages of an item stand, with the longest verbatim run.

    ``longest`` is the length in words of the longest run of consecutive words that document and item share (at least
    ``run``, or 0 if all matches have edits), ``windows`` the verbatim window positions, ``near`` the positions whose
    nearest window of ``run`` words has edits, and ``sized`` those that hold a window of about the item's whole size.

    Method: the windows of the items are embedded by CGK random walks, which turn edit distance into Hamming distance,
    and known by keys that sample places of the embeddings; how many keys, follows from the target recall.  A
    document's windows are embedded the same way where enough of their word pairs are pairs of the items (a necessary
    condition, read from a filter of fixed size), and what has a key in common is verified by exact edit distance.
    Equal windows have all keys in common.  The index is broadcast if it is small (counted first), else keys are
    joined; documents are read whole, in one pass.

    Defined results: null keys or texts and items of fewer than ``run`` words match nothing; repeated documents with
    one key are one; repeated items with different keys are all reported; empty tables give no rows.
    """
    m = cut(window_matches(docs, doc, text, items, item, item_text, run=run, **more))
    small = m.where(F.col("size") == run)
    exact = small.where("dist = 0").distinct().withColumn("diag", F.col("pos") - F.col("ipos"))
    w = Window.partitionBy("doc", "item", "diag").orderBy("pos")
    isle = exact.withColumn("isle", F.col("pos") - F.row_number().over(w)).groupBy("doc", "item", "diag", "isle").agg(F.count("*").alias("k"))
    verbatim = isle.groupBy("doc", "item").agg((F.max("k") + run - 1).cast("int").alias("longest"), F.sum("k").alias("windows"))
    near = small.groupBy("doc", "item", "pos").agg(F.min("dist").alias("dist")).where("dist > 0").groupBy("doc", "item").agg(F.count("*").alias("near"))
    sized = m.where(F.col("size") > run).groupBy("doc", "item").agg(F.countDistinct("pos").alias("sized"))
    both = verbatim.join(near, ["doc", "item"], "full_outer").join(sized, ["doc", "item"], "full_outer")
    return both.select("doc", "item", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("longest", "windows", "near", "sized")))
