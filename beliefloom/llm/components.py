"""Consolidating pairwise matches into groups (connected components by rake and compress)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefloom.session import cut, cut_counting, cut_split, release

#: Arcs of a reduced core that one task solves.
CORE = 200_000


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``node, group_id``: one row per id that is paired with another; group_id is the smallest id of its component.

    Method: each round strips the vertices of degree one and compresses the chains of degree-two vertices, whose ends
    are found by list ranking (pointer doubling over arcs, so a chain of n vertices takes log n joins).  If a round
    removes too little, the core that is left is contracted: each vertex hooks to the neighbour of smallest random
    priority, which leaves less than half of a core whose degrees are two or more.  Once it is reduced to CORE arcs (two
    for each link), a task solves the core.  Every removed vertex remembers the vertex that stands for it; labels are
    restored in reverse order.  The number of rounds grows with the logarithm of the input.  Nothing is collected; a vertex with very many pairs is pre-aggregated for its degree, and joins on it
    are split by adaptive execution.

    Defined results: rows with a null id or with the same id twice are ignored, repeats and directions do not matter,
    no pairs give no rows, other columns are ignored.
    """
    p = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    arcs = cut(p.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct())
    removed: list[DataFrame] = []
    before = None
    while True:
        deg = arcs.groupBy("u").agg(F.count("*").alias("d"), F.min("v").alias("m1"), F.max("v").alias("m2"))
        deg, size = cut_counting(deg, n=F.count("*"), n2=F.sum(F.when(F.col("d") == 2, 1).otherwise(0)), arcs=F.sum("d"))
        n, n2 = size["n"], size["n2"]
        if n == 0:
            release(deg)
            break
        if removed and size["arcs"] <= CORE:
            removed.append(cut(arcs.coalesce(1).mapInArrow(_solve, f"x {arcs.dtypes[0][1]}, rep {arcs.dtypes[0][1]}")))
            release(deg, arcs)
            break
        if before is not None and n > 0.6 * before:
            gone, new = _contract(arcs, len(removed))
            removed.append(gone)
            release(deg, arcs)
            arcs, before = new, None
            continue
        before = n
        ends = deg.select(F.col("u").alias("v"), F.col("d").alias("dv"), "m1", "m2")
        known = cut(arcs.join(deg.select("u", F.col("d").alias("du")), "u").join(ends, "v"))
        leaf = known.where("du = 1 AND (dv >= 3 OR (dv = 1 AND u > v))").select(F.col("u").alias("x"), F.col("v").alias("rep"))
        kept = known.where("du >= 3 AND dv >= 3").select("u", "v")
        if n2:
            chain, edges, used = _compress(known, n2)
            removed.append(cut(leaf.unionByName(chain)))
            new = cut(kept.unionByName(edges).distinct())
            release(*used)
        else:
            removed.append(cut(leaf))
            new = cut(kept)
        release(known, deg, arcs)
        arcs = new
    return _labels(removed) if removed else arcs.select(F.col("u").alias("node"), F.col("v").alias("group_id"))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vertex of a core of bounded size, the smallest of its component apart, with that smallest one."""
    up: dict = {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kind = pa.string()
    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(u), find(v)
            if a != c:
                up[max(a, c)] = min(a, c)
    rows = [(x, r) for x in up if (r := find(x)) != x]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k in (0, 1)], names=["x", "rep"])


def _compress(known: DataFrame, n2: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The degree-two vertices with the vertex that stands for them, the arcs that replace their chains, and the tables these are read from.

    An arc (x, y) with y of degree two is followed in steps that double.  What has reached its end is written once and
    only looked up from then on.
    """
    s = known.where("dv = 2").select(
        F.col("u").alias("x"), F.col("v").alias("y"), F.col("v").alias("ex"),
        F.when(F.col("m1") == F.col("u"), F.col("m2")).otherwise(F.col("m1")).alias("ey"), F.col("v").alias("mn"),
    )
    going, finished, before = cut(s), [], None
    look = lambda s, done: s.select(F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("ex").alias("ex2"), F.col("ey").alias("ey2"), F.col("mn").alias("mn2"), F.lit(done).alias("done2"))
    for _ in range(math.ceil(math.log2(n2 + 1)) + 1):
        r = look(going, False)
        for f in finished:
            r = r.unionByName(look(f, True))
        on = going.join(r, ["ex", "ey"], "left").select(
            "x", "y", F.coalesce("ex2", "ex").alias("ex"), F.coalesce("ey2", "ey").alias("ey"), F.least("mn", F.coalesce("mn2", "mn")).alias("mn"),
            F.coalesce("done2", F.lit(True)).alias("done"), F.coalesce(F.col("mn2") < F.col("mn"), F.lit(False)).alias("fell"),
        )
        left = lambda c: F.sum(F.when(~F.col("done") & c, 1).otherwise(0))
        done, now, size = cut_split(on, "done", n=left(F.lit(True)), fell=left(F.col("fell")))
        finished.append(done.drop("fell"))
        finished[-1]._beliefloom_path = done._beliefloom_path
        release(going)
        going = now.drop("fell")
        going._beliefloom_path = now._beliefloom_path
        # An unfinished chain finishes some arc in every step, so if none did only rings are left; their least vertices
        # are known once no minimum falls any more.
        if not size["n"] or (size["n"] == before and not size["fell"]):
            break
        before = size["n"]
    every = finished[0]
    for f in finished[1:]:
        every = every.unionByName(f)
    ends = cut(every.groupBy("y").agg(F.min("ey").alias("lo"), F.max("ey").alias("hi")))
    ring = going.groupBy("y").agg(F.min("mn").alias("lo")).where("y <> lo")
    chain = ends.select(F.col("y").alias("x"), F.col("lo").alias("rep")).unionByName(ring.select(F.col("y").alias("x"), F.col("lo").alias("rep")))
    link = ends.where("lo <> hi").select("lo", "hi").distinct()
    edges = link.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(link.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    return chain, edges, [ends, going, *finished]


def _contract(arcs: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Hooks every vertex of the core to its neighbour of smallest random priority and contracts the trees."""
    pri = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))
    hook = arcs.groupBy("u").agg(F.min(pri("v")).alias("m")).select(
        F.col("u").alias("x"), F.when(F.col("m") < pri("u"), F.col("m.id")).otherwise(F.col("u")).alias("rep")
    )
    hook = cut(hook)
    while True:
        up = hook.select(F.col("x").alias("rep"), F.col("rep").alias("top"))
        nxt = hook.join(up, "rep").select("x", F.col("top").alias("rep"), (F.col("top") != F.col("rep")).alias("moved"))
        nxt, far = cut_counting(nxt, n=F.sum(F.when(F.col("moved"), 1).otherwise(0)))
        release(hook)
        hook = nxt.select("x", "rep")
        hook._beliefloom_path = nxt._beliefloom_path
        if not far["n"]:
            break
    to = hook.select(F.col("x").alias("u"), F.col("rep").alias("ru"))
    new = arcs.join(to, "u").join(to.select(F.col("u").alias("v"), F.col("ru").alias("rv")), "v").where("ru <> rv")
    new = cut(new.select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
    gone = cut(hook.where("x <> rep"))
    release(hook)
    return gone, new


def _labels(removed: list[DataFrame]) -> DataFrame:
    """Restores labels in reverse order of removal and names each group by its smallest id.

    The labels known so far are a table of their own after each level, so no plan holds more than one level.
    """
    known = None
    for r in reversed(removed):
        if known is None:
            new = cut(r.select("x", F.col("rep").alias("label")))
        else:
            top = known.select(F.col("x").alias("rep"), "label")
            new = cut(known.unionByName(r.join(top, "rep", "left").select("x", F.coalesce("label", "rep").alias("label"))))
        release(known, r)
        known = new
    least = known.groupBy("label").agg(F.min("x").alias("m")).select("label", F.least("label", "m").alias("group_id"))
    roots = least.select(F.col("label").alias("node"), "group_id")
    return known.join(least, "label").select(F.col("x").alias("node"), "group_id").unionByName(roots)
