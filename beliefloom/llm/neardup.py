"""Near-duplicate records with small edits: token-combination prefixes, then exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefloom.llm import joins
from beliefloom.llm.components import components
from beliefloom.session import cut, cut_counting, release

#: A signature should be shared by about this many records at most, if tokens were independent.
LIST = 100
#: Tokens of a group within which combinations are made.
GROUP = 8
#: Records of different classes that may hold a signature before it is extended by one more token.
HOT = 1_000
#: Up to this size a record may have too few tokens for its combinations at some threshold of 0.5 or more.
SHORT = 7
#: Least and most bits of the filter of shared signatures; tokens that are worked on at once.
FILTER_BITS, BLOCK = (1 << 20, 1 << 27), 1 << 17
_P = np.uint64(0x9E3779B97F4A7C15)


def token_classes(df: np.ndarray, records: int, target: int = LIST) -> np.ndarray:
    """How many tokens of these frequencies are combined: the smallest k with records * (df / records) ** k <= target, at most 3."""
    return 1 + (df > target).astype(np.int64) + (df > math.sqrt(target * records)).astype(np.int64)


def level(size: np.ndarray | int) -> np.ndarray:
    """Tokens that are combined are parted into 2 ** level groups by their hash, of about GROUP to 2 * GROUP tokens of a record."""
    return np.floor(np.log2(np.maximum(np.asarray(size) / GROUP, 1))).astype(np.int64)


def needs(size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that a prefix must survive, plus one: of a record found by larger ones, and of one that asks for smaller ones."""
    size = np.asarray(size)
    kept = 2 * t / (1 + t)
    return size - np.ceil(kept * size - 1e-9).astype(np.int64) + 1, size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _P + np.uint64(0x7F4A7C15)
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=4096)
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)


class Tokens:
    """The tokens of some records, one record after another, rarest first."""

    def __init__(self, df: np.ndarray, item: np.ndarray, size: np.ndarray, t: float, records: int, target: int = LIST):
        self.item, self.size, self.t = item, size, t
        self.first = np.cumsum(size) - size
        self.rec = np.repeat(np.arange(len(size)), size)
        self.k = token_classes(df, records, target)
        self.low, self.high = needs(size, t)

    def prefix(self, need: np.ndarray, lev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(inside, order): which tokens belong to the prefix that survives ``need - 1`` missing ones; the order of groups.

        Tokens of class k are combined k at a time inside groups, so that a record of n tokens has on the order of n
        combinations.  Missing tokens destroy all combinations of a group of m tokens only after m - k + 1 of them, so
        the prefix is extended until these numbers add up to ``need``; it is empty if a record does not reach that.
        """
        rec, k = self.rec, self.k
        part = np.where(k > 1, (self.item >> np.uint64(17)).astype(np.int64) & ((1 << lev[rec]) - 1), 0)
        order = np.lexsort((np.arange(len(k)), part, k, rec))
        self.key = np.stack([rec, k, part])
        begin = self._begins(order)
        rank = np.empty(len(k), np.int64)
        rank[order] = np.arange(len(k)) - np.repeat(begin, np.diff(np.append(begin, len(k))))
        total = np.concatenate([[0], np.cumsum(rank >= k - 1)])
        enough = total[self.first + self.size] - total[self.first] >= need
        return (total[:-1] - total[self.first[rec]] < need[rec]) & enough[rec], order

    def _begins(self, order: np.ndarray) -> np.ndarray:
        key = self.key[:, order]
        return np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))

    def combinations(self, need: np.ndarray, lev: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(k, positions of k tokens in each row) of the combinations of all records' prefixes."""
        inside, order = self.prefix(need, lev)
        at = order[inside[order]]
        if not len(at):
            return
        begin = self._begins(at)
        many, k = np.diff(np.append(begin, len(at))), self.k[at[begin]]
        for kk in (1, 2, 3):
            for n in np.unique(many[(k == kk) & (many >= kk)]):
                groups = at[begin[(k == kk) & (many == n)][:, None] + np.arange(n)]
                yield kk, groups[:, _choices(int(n), kk)].reshape(-1, kk)

    def signatures(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(record, signature, found, tokens): a record asks with all of them, and is found by those marked ``found``.

        It asks for smaller or equal records at its own level, and at the one below if a record that is like it may be
        small enough for that.  tokens are the positions of the combined tokens, filled up with -1.
        """
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros((0, 3), np.int64))]
        if not len(self.rec):
            return out[0]
        rec, size, none = self.rec, self.size, np.zeros(len(self.size), np.int64)

        def add(pos: np.ndarray, lev: np.ndarray, code: int, last: np.ndarray) -> None:
            base = rec[pos[:, 0]]
            sig = np.uint64(code) + np.uint64(16) * lev[base].astype(np.uint64)
            for column in np.sort(self.item[pos], axis=1).T:
                sig = _mix(sig, column)
            wide = np.full((len(pos), 3), -1, np.int64)
            wide[:, : pos.shape[1]] = pos
            out.append((base, sig, pos.max(axis=1) <= last[base], wide))

        own, below = level(size), level(np.maximum(np.ceil(self.t * size - 1e-9), 1))
        # What a record is found by are the combinations of its shorter prefix.
        inside, _ = self.prefix(self.low, own)
        last = np.full(len(size), -1, np.int64)
        np.maximum.at(last, rec[inside], np.flatnonzero(inside))
        for k, pos in self.combinations(self.high, own):
            add(pos, own, k, last)
        for k, pos in self.combinations(np.where(below < own, self.high, 0), below):
            add(pos, below, k, none - 1)
        # Records that are too short for combinations, and all that may be like one of those, also use single tokens.
        pos = np.flatnonzero((size[rec] <= SHORT / self.t) & (np.arange(len(rec)) - self.first[rec] < self.high[rec]))
        if len(pos):
            add(pos[:, None], none, 8, self.first + self.low - 1)
        return tuple(np.concatenate([x[c] for x in out]) for c in range(4))  # type: ignore[return-value]


def _blocks(batches: Iterator[pa.RecordBatch], t: float, records: int, target: int) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Parts of the batches (with n, df, item) of about BLOCK tokens (one record may have more), and their tokens."""
    for b in batches:
        n = np.asarray(b.column("n")).astype(np.int64)
        ends = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, side="right")))
            part = b.slice(lo, hi - lo)
            yield part, Tokens(np.asarray(part.column("df").flatten()), np.asarray(part.column("item").flatten()).view(np.uint64), n[lo:hi], t, records, target)
            lo = hi


def _only_signatures(t: float, records: int, target: int):
    """mapInArrow: sig, found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens in _blocks(batches, t, records, target):
            _, sig, found, _ = tokens.signatures()
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(found)], names=["sig", "found"])

    return run


def _bit(sig: np.ndarray, bits: int) -> np.ndarray:
    return ((sig * _P) >> np.uint64(20)).astype(np.int64) & (bits - 1)


def _set_bits(bits: int):
    """mapInArrow over sig: words (place, bits) of the filter, those that a block sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bit(np.asarray(b.column("sig")).view(np.uint64), bits))
            place, first = np.unique(at >> 6, return_index=True)
            if len(at):
                word = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(word.view(np.int64))], names=["at", "bits"])

    return run


def _emit(t: float, records: int, target: int, shared, bits: int, *more: str):
    """mapInArrow: sig, rid, n, b0, b1, found and ``more`` columns for the signatures that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b, tokens in _blocks(batches, t, records, target):
            rec, sig, found, _ = tokens.signatures()
            at = _bit(sig, bits)
            hit = np.flatnonzero((known[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            rows = b.select(["rid", "n", "b0", "b1", *more]).take(pa.array(rec[hit]))
            yield pa.RecordBatch.from_arrays([pa.array(sig[hit].view(np.int64)), *rows.columns[:4], pa.array(found[hit]), *rows.columns[4:]], names=["sig", "rid", "n", "b0", "b1", "found", *more])

    return run


def _extend(t: float, records: int, target: int):
    """mapInArrow: rows (sig, rid, n, b0, b1, found, cls, df, item) of hot signatures become rows of that signature and one more token.

    Two like records that share a combination of k tokens share at least (what they must share) - k of the others, so
    the usual single-token prefix of the others serves.  Short records, which might share nothing else, and all that
    may be like one keep the signature as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, tokens in _blocks(batches, t, records, target):
            want = np.asarray(b.column("sig")).view(np.uint64)
            rec, sig, _, pos = tokens.signatures()
            mine = np.flatnonzero(sig == want[rec])
            gone = np.zeros(len(tokens.rec), bool)
            used, first = np.unique(rec[mine], return_index=True)
            taken = pos[mine[first]]
            gone[taken[taken >= 0]] = True
            left = np.cumsum(~gone) - 1
            start = np.concatenate([[0], np.cumsum(~gone)])[tokens.first]
            place = left - start[tokens.rec]
            at = np.flatnonzero(~gone & (place < tokens.high[tokens.rec]))
            base = tokens.rec[at]
            new = _mix(_mix(np.full(len(at), 9, np.uint64), want[base]), tokens.item[at])
            keep = np.flatnonzero(tokens.size <= SHORT / t)
            has = np.asarray(b.column("found"))
            rows = np.concatenate([base, keep])
            out = b.select(["rid", "n", "b0", "b1", "cls"]).take(pa.array(rows))
            found = np.concatenate([has[base] & (place[at] < tokens.low[base]), has[keep]])
            sigs = np.concatenate([new, want[keep]])
            yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), *out.columns[:4], pa.array(found), out.column(4)], names=["sig", "rid", "n", "b0", "b1", "found", "cls"])

    return run


def _verified(candidates: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """rid, rid2 of the candidates whose words have a likeness of at least t."""
    w = texts.select("rid", "words")
    pairs = candidates.join(w, "rid").join(w.select(F.col("rid").alias("rid2"), F.col("words").alias("words2")), "rid2")
    return pairs.where(joins.likeness() >= t - 1e-12).select("rid", "rid2")


def near_links(texts: DataFrame, t: float, *, target: int = LIST, hot: int = HOT) -> DataFrame:
    """``rid, rid2``: verified pairs of word sets with a likeness of at least t >= 0.5, enough to connect all that are alike.

    ``texts`` has rid and words (sorted, distinct).  Exact: combinations only choose candidates, none are capped.  First
    each record is compared with the smallest record of each of its signatures; a record that is like one of these is of
    its class.  Then only records of different classes meet, so a group of m texts that are all alike takes m links
    instead of all its pairs.  A signature that more than ``hot`` records in more than one class hold is extended by one
    more token, so templates that very many texts share do not meet on the template's words alone.
    """
    if t < 0.5:
        raise ValueError("t must be at least 0.5")
    texts = cut(texts.withColumn("h", joins.hashes()))
    items = texts.select("rid", F.explode("h").alias("item"), F.lit(1).alias("w"))
    full = joins.ranked(items).join(texts.select("rid", F.size("words").alias("n"), *joins.bitmap(F.col("h"))), "rid")
    full = full.select("rid", "n", "b0", "b1", F.transform("its", lambda x: x["df"]).alias("df"), F.transform("its", lambda x: x["item"]).alias("item"))
    full, size = cut_counting(full, n=F.count("*"))
    records = max(size["n"], 1)
    # Signatures that one record alone holds are most of them; only what several hold is ever joined.
    several = full.select("n", "df", "item").mapInArrow(_only_signatures(t, records, target), "sig long, found boolean").groupBy("sig").agg(F.count("*").alias("k"), F.max("found").alias("f"))
    several, size = cut_counting(several.where("k > 1 AND f").select("sig"), n=F.count("*"))
    bits = min(max(FILTER_BITS[0], 1 << math.ceil(math.log2(16 * size["n"] + 1))), FILTER_BITS[1])
    shared = np.zeros(bits // 64, np.uint64)
    got = several.mapInArrow(_set_bits(bits), "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    shared[np.asarray(got.column("at").combine_chunks())] = np.asarray(got.column("bits").combine_chunks()).view(np.uint64)
    release(several)
    known = full.sparkSession.sparkContext.broadcast(shared)
    narrow = "sig long, rid binary, n int, b0 long, b1 long, found boolean"
    sigs = cut(full.mapInArrow(_emit(t, records, target, known, bits), narrow))
    lead = sigs.where("found").groupBy("sig").agg(F.min(F.struct(F.col("n").alias("n2"), F.col("rid").alias("rid2"), F.col("b0").alias("c0"), F.col("b1").alias("c1"))).alias("m")).select("sig", "m.*")
    smaller = (F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("rid") > F.col("rid2")))
    star = sigs.join(lead, "sig").where(smaller & joins.within(t)).select("rid", "rid2").distinct()
    star = cut(_verified(star, texts, t))
    release(sigs)
    cls = star.groupBy("rid").agg(F.min("rid2").alias("cls"))
    own = full.join(cls, "rid", "left").withColumn("cls", F.coalesce("cls", "rid"))
    sigs = own.mapInArrow(_emit(t, records, target, known, bits, "cls"), f"{narrow}, cls binary")
    mixed = sigs.groupBy("sig").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.sum(F.col("found").cast("int")).alias("k")).where("lo <> hi AND k > 0")
    rest = cut(sigs.join(mixed.select("sig", "k"), "sig"))
    wide = rest.where(F.col("k") > hot).join(full.select("rid", "df", "item"), "rid").select(*rest.columns[:-1], "df", "item")
    rest = rest.where(F.col("k") <= hot).drop("k").unionByName(wide.mapInArrow(_extend(t, records, target), f"{narrow}, cls binary"))
    has = rest.where("found").select("sig", F.col("rid").alias("rid2"), F.col("n").alias("n2"), F.col("b0").alias("c0"), F.col("b1").alias("c1"), F.col("cls").alias("cls2"))
    cand = rest.drop("found").join(has, "sig").where(smaller & (F.col("cls") != F.col("cls2")) & joins.within(t)).select("rid", "rid2").distinct()
    return star.unionByName(_verified(cand, texts, t))


def near_groups(rows: DataFrame, key: str, text: str, t: float = 0.8, *, target: int = LIST, hot: int = HOT) -> DataFrame:
    """``key, group_id``: rows whose texts have a likeness (words shared over words in either) of at least t, also through others.

    One row per key of a group of two or more keys; group_id is the group's smallest key.  Texts alike in all words are
    one record before anything is compared, so a text that a third of the rows repeat costs one comparison partner.

    Method: tokens are ordered from rare to frequent; single tokens of rare classes and combinations of two or three
    tokens of frequent classes are indexed, over prefixes extended so that every pair above t shares one.  Tokens are
    combined only inside groups of bounded size, so the signatures of a text grow with its length and not with a power
    of it.  Candidates are narrowed by size and a 128-bit bitmap, both exact bounds, and verified on the words; groups
    are the components of the verified links (see near_links).

    Defined results: null keys, null texts and texts without words belong to no group; a key with several texts links
    them; repeated rows and other columns do not matter; an empty table gives no rows.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    texts, members = joins.distinct_texts(rows, "t", ["k"], as_set=True, keep=True)
    members = cut(members)
    pairs = near_links(texts, t, target=target, hot=hot)
    # A link from each key to the smallest key with the same words, and between those for like texts: never all pairs of copies.
    first = cut(members.groupBy("rid").agg(F.min("k").alias("m")))
    links = members.join(first, "rid").where("k <> m").select(F.col("k").alias("a"), F.col("m").alias("b"))
    f2 = first.select(F.col("rid").alias("rid2"), F.col("m").alias("b"))
    like = pairs.join(first.withColumnRenamed("m", "a"), "rid").join(f2, "rid2").select("a", "b")
    out = components(links.unionByName(like), "a", "b")
    return out.select(F.col("node").alias(key), "group_id")
