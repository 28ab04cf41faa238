"""Parent-child links to full hierarchies: path, depth, root, descendants, cycles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefloom.session import cut, cut_counting, cut_split, release

#: Levels that a frontier takes one by one; what lies deeper is reached in steps that double.
LEVELS = 6


def _edges(links: DataFrame, child: str, parent: str) -> DataFrame:
    df = links.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL AND p IS NOT NULL")
    return df.groupBy("c").agg(F.min("p").alias("p"))


def other_parents(links: DataFrame, child: str, parent: str) -> DataFrame:
    """``child, parent`` of the links that hierarchy() leaves out because the child has a smaller parent too."""
    df = links.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL AND p IS NOT NULL").distinct()
    return df.join(_edges(links, child, parent).withColumnRenamed("p", "first"), "c").where("p <> first").select(F.col("c").alias(child), F.col("p").alias(parent))


def hierarchy(links: DataFrame, child: str, parent: str, *, paths: bool = False) -> DataFrame:
    """One row per id in a link: ``node, root, depth, cyclic`` and, with ``paths``, ``path`` from the root to the node.

    A root has depth 0.  For ids on a cycle or below one, ``cyclic`` is true, depth is -1, root is the smallest id on
    that cycle and path is null.  A link from an id to itself is a cycle.

    Method: a frontier that starts at the roots is joined level by level with the links, extending paths and depths.
    Nodes below the first LEVELS levels are joined with one another instead, each with the ancestor it knows so far, so
    that the known part of the way doubles with every join until it meets the frontier's nodes; the rounds grow with the
    logarithm of the depth.  What is not reached that way is on or below a cycle, which pointer doubling finds.
    Joins are plain equi-joins; adaptive execution splits the partition of a parent with very many children.

    Defined results: rows with a null id are ignored, repeated links count once, of several parents of a node the
    smallest counts (other_parents() has the rest), no links give no rows, other columns are ignored.
    """
    base = cut(_edges(links, child, parent))
    add = ["path"] if paths else []
    roots = base.select(F.col("p").alias("node")).distinct().join(base.select(F.col("c").alias("node")), "node", "left_anti")
    roots = roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), *([F.array("node").alias("path")] if paths else []))
    front, size = cut_counting(roots, n=F.count("*"))
    done = [front]
    while size["n"] and len(done) <= LEVELS:
        f = front.select(F.col("node").alias("p"), "root", "depth", *([F.col("path").alias("above")] if paths else []))
        step = f.join(base, "p").select(F.col("c").alias("node"), "root", (F.col("depth") + 1).alias("depth"), *([F.concat("above", F.array("c")).alias("path")] if paths else []))
        front, size = cut_counting(step, n=F.count("*"))
        done.append(front)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    rest, left = cut_counting(base.join(out.select(F.col("node").alias("c")), "c", "left_anti"), n=F.count("*"))
    lost, lost_n = rest, left["n"]
    if left["n"] and size["n"]:
        deep, lost, lost_n = _deep(rest, left["n"], paths)
        top = out.select(F.col("node").alias("top"), "root", F.col("depth").alias("above"), *([F.col("path").alias("before")] if paths else []))
        deep = deep.join(top, "top").select(F.col("x").alias("node"), "root", (F.col("above") + F.col("dist")).alias("depth"), *([F.concat("before", "path").alias("path")] if paths else []))
        out = out.unionByName(deep)
    out = out.withColumn("cyclic", F.lit(False))
    if lost_n:
        ring = _cycles(lost, lost_n)
        ring = ring.select("node", "root", F.lit(-1).alias("depth"), *([F.lit(None).cast(f"array<{base.schema['c'].dataType.simpleString()}>").alias("path")] if paths else []), F.lit(True).alias("cyclic"))
        out = out.unionByName(ring)
    return out.select("node", "root", "depth", "cyclic", *add)


def _deep(rest: DataFrame, n: int, paths: bool) -> tuple[DataFrame, DataFrame, int]:
    """(x, top, dist, path) of the nodes of rest (c, p) from which a node outside is reached; c, p of the others; how many.

    In every step some node reaches the outside, or all that are left lead into a cycle.  What has arrived is written
    once and only looked up from then on.
    """
    way = [F.array("c").alias("path")] if paths else []
    going = cut(rest.select(F.col("c").alias("x"), "p", F.col("p").alias("top"), F.lit(1).cast("long").alias("dist"), *way))
    arrived: list[DataFrame] = []
    look = lambda s, done: s.select(F.col("x").alias("top"), F.col("top").alias("top2"), F.col("dist").alias("dist2"), *([F.col("path").alias("path2")] if paths else []), F.lit(done).alias("done2"))
    while n:
        r = look(going, False)
        for a in arrived:
            r = r.unionByName(look(a, True))
        on = going.join(r, "top", "left").select(
            "x", "p", F.coalesce("top2", "top").alias("top"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
            *([F.when(F.col("top2").isNull(), F.col("path")).otherwise(F.concat("path2", "path")).alias("path")] if paths else []),
            F.coalesce("done2", F.lit(True)).alias("done"),
        )
        done, now, size = cut_split(on, "done", n=F.sum(F.when(~F.col("done"), 1).otherwise(0)))
        release(going)
        going = now
        arrived.append(done)
        if size["n"] == n:
            break
        n = size["n"]
    out = arrived[0]
    for a in arrived[1:]:
        out = out.unionByName(a)
    return out.withColumn("dist", F.col("dist").cast("int")), going.select(F.col("x").alias("c"), "p"), n


def _cycles(lost: DataFrame, n: int) -> DataFrame:
    """node, root for nodes whose parents lead into a cycle: pointer doubling over at least n steps."""
    state = lost.select(F.col("c").alias("x"), F.col("p").alias("ptr"), F.col("c").alias("mn"))
    for _ in range(max(1, math.ceil(math.log2(n + 1)))):
        right = state.select(F.col("x").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("mn").alias("mn2"))
        new = cut(state.join(right, "ptr").select("x", F.col("ptr2").alias("ptr"), F.least("mn", "mn2").alias("mn")))
        release(state)
        state = new
    on = state.select("ptr").distinct().join(state.select(F.col("x").alias("ptr"), F.col("mn").alias("root")), "ptr")
    return state.join(on, "ptr").select(F.col("x").alias("node"), "root")


def descendants(tree: DataFrame) -> DataFrame:
    """``ancestor, node, distance`` for all nodes below each node; tree is ``hierarchy(..., paths=True)``."""
    t = tree.where("path IS NOT NULL AND depth > 0")
    pos = F.posexplode(F.slice("path", 1, F.col("depth"))).alias("at", "ancestor")
    return t.select("node", "depth", pos).select("ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))


def cycle_members(tree: DataFrame) -> DataFrame:
    """``cycle, nodes``: how many ids are on or below each cycle, named by its smallest id."""
    return tree.where("cyclic").groupBy(F.col("root").alias("cycle")).agg(F.count("*").alias("nodes"))
