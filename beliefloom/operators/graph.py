"""Closures, distances, path counts, impact and revision over support graphs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beliefloom.session import cut

#: Edges up to which a walk runs as one task's kernel, and edges times roots; both are counted first. Larger ones use joins.
KERNEL_EDGES, KERNEL_STEPS, KERNEL_ROOTS = 1_000_000, 16_000_000, 4096
#: Bytes, about, and 64-bit words of a row that the bit sets of a block take.
SET_BYTES, SET_WORDS = 1 << 25, 64
#: Places (walks of a block times nodes) that a block of counted walks keeps; rows of a batch of visits.
PLACES, ROWS = 1 << 24, 65_536
#: Smallest change that propagates; largest path count.
CUTOFF, SATURATED = 0.005, 10**15


def closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``source, target, distance`` for all pairs with a path: min-plus squaring, log(depth) rounds of equi-joins.

    Cycles are allowed (a node on one reaches itself); repeated edges count once.
    """
    best = cut(edges.select(F.col(source).alias("s"), F.col(target).alias("t"), F.lit(1).alias("d")).where("s IS NOT NULL AND t IS NOT NULL").distinct())
    size = best.count()
    while True:
        a, b = best, best.select(F.col("s").alias("t"), F.col("t").alias("u"), F.col("d").alias("e"))
        longer = a.join(b, "t").select("s", F.col("u").alias("t"), (F.col("d") + F.col("e")).alias("d"))
        best = cut(a.unionByName(longer).groupBy("s", "t").agg(F.min("d").alias("d")))
        now = best.count()
        if now == size:
            break
        size = now
    return best.select(F.col("s").alias(source), F.col("t").alias(target), F.col("d").alias("distance"))


def _groups(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes its strongly connected group; the groups that a group points to have lower numbers (Tarjan)."""
    order = np.argsort(a, kind="stable")
    to, first = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    index, low, group, at = [-1] * n, [0] * n, [-1] * n, first[:-1]
    stack, count, groups = [], 0, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
            while at[v] < first[v + 1]:
                x = to[at[v]]
                if index[x] < 0:
                    path.append(x)
                    break
                if group[x] < 0:
                    low[v] = min(low[v], low[x])
                at[v] += 1
            else:
                path.pop()
                if low[v] == index[v]:
                    while True:
                        x = stack.pop()
                        group[x] = groups
                        if x == v:
                            break
                    groups += 1
    return np.array(group, np.int64)


def lineage(edges: DataFrame, source: str, target: str) -> dict | None:
    """A graph of a proven bounded size for walks with bit sets: names in order, the group of each, steps up and down.

    None if the graph has more than KERNEL_EDGES edges.  Nodes on a common cycle are one group, so the groups have no
    cycle; a step holds the edges whose ends are complete, given as (from, to) groups ordered by to.
    """
    e = cut(edges.select(F.col(source).cast("string").alias("s"), F.col(target).cast("string").alias("t")).where("s IS NOT NULL AND t IS NOT NULL").distinct())
    if e.limit(KERNEL_EDGES + 1).count() > KERNEL_EDGES:
        return None
    got = e.toArrow()
    s, t = (got.column(c).combine_chunks() for c in ("s", "t"))
    names = pc.unique(pa.concat_arrays([s, t]))
    names = names.take(pc.array_sort_indices(names))
    a, b = (np.asarray(pc.index_in(x, names)).astype(np.int64) for x in (s, t))
    group = _groups(len(names), a, b)
    ga, gb = group[a], group[b]
    n = int(group.max()) + 1 if len(group) else 0
    cyclic = np.zeros(n, bool)
    cyclic[ga[ga == gb]] = True
    pair = np.unique(np.stack([ga, gb], 1)[ga != gb], axis=0).reshape(-1, 2)
    height = [0] * n
    for x, y in pair.tolist():  # in the order of x: everything below it is known
        height[x] = max(height[x], height[y] + 1)
    h = np.array(height, np.int64)

    def steps(frm, to, rank):
        order = np.lexsort((frm, to, rank))
        ends = np.searchsorted(rank[order], np.unique(rank), side="right").tolist()
        return [(frm[order[lo:hi]], to[order[lo:hi]]) for lo, hi in zip([0, *ends[:-1]], ends)]

    x, y = pair[:, 0], pair[:, 1]
    return {"names": names, "group": group, "cyclic": cyclic, "rests": cyclic | (h > 0), "up": steps(y, x, h[x]), "down": steps(x, y, -h[y]), "words": max(1, min(SET_WORDS, SET_BYTES // (8 * max(1, n, len(pair)))))}


def _own(groups: np.ndarray, n: int, words: int) -> np.ndarray:
    """(n, words) bit sets; bit k is set in the k-th of groups."""
    out, k = np.zeros((n, words), np.uint64), np.arange(len(groups))
    np.bitwise_or.at(out, (groups, k >> 6), np.uint64(1) << (k & 63).astype(np.uint64))
    return out


def _spread(sets: np.ndarray, steps: list) -> None:
    """Adds the sets of the near ends of edges to those of their far ends, step by step."""
    for frm, to in steps:
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        sets[to[first]] |= np.bitwise_or.reduceat(sets[frm], first, axis=0)


def _blocks(edges: DataFrame, n: int, width: int) -> DataFrame:
    """One row, in a task of its own as far as 256 tasks go, for each ``width`` of n things."""
    k = -(-n // width)
    return edges.sparkSession.range(0, k, 1, max(1, min(k, 256)))


def reached(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``source, n``: how many nodes each node has a path to (itself only on a cycle), if any.

    A graph of a proven bounded size is walked with bit sets, a block of targets in each task, so that no pair of nodes
    is ever a row; a larger one takes closure().
    """
    g = lineage(edges, source, target)
    if g is None:
        return closure(edges, source, target).groupBy(source).agg(F.count("*").alias("n"))
    shared, width = edges.sparkSession.sparkContext.broadcast(g), 64 * g["words"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        group, n = g["group"], np.zeros(len(g["cyclic"]), np.int64)
        for b in batches:
            for k in b.column(0).to_pylist():
                own = _own(group[k * width : (k + 1) * width], len(n), width // 64)
                sets = own.copy()
                _spread(sets, g["up"])
                sets[~g["cyclic"]] &= ~own[~g["cyclic"]]
                n += np.bitwise_count(sets).sum(axis=1, dtype=np.int64)
        some = np.flatnonzero(n[group])
        yield pa.RecordBatch.from_arrays([g["names"].take(pa.array(some)), pa.array(n[group][some])], names=["node", "n"])

    kind = edges.schema[source].dataType.simpleString()
    return _blocks(edges, len(g["names"]), width).mapInArrow(count, "node string, n long").groupBy(F.col("node").cast(kind).alias(source)).agg(F.sum("n").alias("n"))


def reach(edges: DataFrame, source: str, target: str, roots: DataFrame) -> DataFrame:
    """``root, node, distance, path_count``: breadth-first layers from each root, with the number of shortest paths.

    Counts saturate at 10**15.  The root itself is not in the result, also on a cycle.  roots has a column ``root``.
    Few roots on a graph of a proven bounded size are walked by one task; anything else takes one join per layer.
    """
    e = cut(edges.select(F.col(source).cast("string").alias("at"), F.col(target).cast("string").alias("to")).where("at IS NOT NULL AND to IS NOT NULL").distinct())
    roots = roots.select(F.col("root").cast("string").alias("root")).where("root IS NOT NULL").distinct()
    few = [r[0] for r in roots.limit(KERNEL_ROOTS + 1).collect()]
    size = e.limit(KERNEL_EDGES + 1).count() if len(few) <= KERNEL_ROOTS else KERNEL_EDGES + 1
    if size <= KERNEL_EDGES and size * len(few) <= KERNEL_STEPS:
        return e.coalesce(1).mapInArrow(_layers(few), "root string, node string, distance int, path_count long")
    return _reach_joins(e, roots)


def _layers(roots: list[str]):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list[str]] = {}
        for b in batches:
            for a, t in zip(b.column("at").to_pylist(), b.column("to").to_pylist()):
                out.setdefault(a, []).append(t)
        for root in roots:
            seen, layer, depth = {root}, {root: 1}, 0
            while layer:
                depth += 1
                nxt: dict[str, int] = {}
                for a, k in layer.items():
                    for t in out.get(a, ()):
                        if t not in seen:
                            nxt[t] = min(nxt.get(t, 0) + k, SATURATED)
                seen.update(nxt)
                layer = nxt
                if nxt:
                    n = len(nxt)
                    yield pa.RecordBatch.from_arrays([pa.array([root] * n), pa.array(list(nxt)), pa.array([depth] * n, pa.int32()), pa.array(list(nxt.values()), pa.int64())], names=["root", "node", "distance", "path_count"])

    return walk


def _reach_joins(e: DataFrame, roots: DataFrame) -> DataFrame:
    front = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance"), F.lit(1).cast("decimal(38,0)").alias("k")).distinct())
    seen, layers, depth = front, [], 0
    while True:
        depth += 1
        nxt = front.withColumnRenamed("node", "at").join(e, "at").groupBy("root", F.col("to").alias("node")).agg(F.sum("k").alias("k"))
        nxt = nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        nxt = cut(nxt.select("root", "node", F.lit(depth).alias("distance"), F.least(F.col("k").cast("decimal(38,0)"), F.lit(SATURATED).cast("decimal(38,0)")).alias("k")))
        if nxt.isEmpty():
            break
        layers.append(nxt)
        seen = seen.unionByName(nxt)
        front = nxt
    out = front.limit(0) if not layers else layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out.select("root", "node", "distance", F.col("k").cast("long").alias("path_count"))


def impact(edges: DataFrame, roots: DataFrame, decisions: DataFrame) -> DataFrame:
    """``root, kind, id, distance, path_count``: claims that rest on a root and decisions whose basis holds one of these or the root.

    A decision stands one step behind the nearest claim of its basis.
    """
    claims = reach(edges, "supports_id", "claim_id", roots)
    near = claims.select("root", "node", "distance", "path_count").unionByName(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance"), F.lit(1).cast("long").alias("path_count")))
    basis = decisions.select("decision_id", F.explode("basis").alias("node")).distinct()
    hit = basis.join(near, "node")
    least = hit.groupBy("root", "decision_id").agg(F.min(F.struct("distance")).alias("m"))
    hit = hit.join(least, ["root", "decision_id"]).where(F.col("distance") == F.col("m.distance"))
    dec = hit.groupBy("root", F.col("decision_id").alias("id")).agg((F.min("distance") + 1).alias("distance"), F.least(F.sum("path_count"), F.lit(SATURATED)).alias("path_count"))
    one = claims.select("root", F.lit("claim").alias("kind"), F.col("node").alias("id"), "distance", "path_count")
    return one.unionByName(dec.select("root", F.lit("decision").alias("kind"), "id", "distance", "path_count"))


def capped(found: DataFrame, max_results: int = 1000, max_depth: int | None = None) -> tuple[DataFrame, list[str]]:
    """The nearest results, in the order (distance, id, kind), and why the list was cut, if it was."""
    why = []
    kept = found
    if max_depth is not None:
        kept = found.where(F.col("distance") <= max_depth)
        if not found.where(F.col("distance") > max_depth).isEmpty():
            why.append("max_depth")
    if kept.limit(max_results + 1).count() > max_results:
        why.append("max_results")
    return kept.orderBy("distance", "id", "kind").limit(max_results), why


def revisit_order(out: dict[str, list[str]], root: str) -> list[str]:
    """Breadth-first order of the dependents of root; neighbours in the order given."""
    seen, order, queue = {root}, [], deque([root])
    while queue:
        for x in out.get(queue.popleft(), ()):
            if x not in seen:
                seen.add(x)
                order.append(x)
                queue.append(x)
    return order


def passes(claims: dict[str, tuple], edges: list[tuple], combos: dict[str, tuple], changes: list[tuple[str, float]], cutoff: float = CUTOFF) -> Iterator[tuple]:
    """(root, claim_id, old, new, flagged, position, moved) of every claim that each root's change visits.

    claims: id -> (score, materiality, critical); edges: (seq, from_us, claim, supporter, p_given, p_given_not, strength);
    combos: id -> (kind, leak).  Dependents are visited once, in breadth-first order by edge seq.  A claim with a combo
    is computed jointly from all parents; any other takes over what its updated supporters say, in the order (from_us,
    seq), the last one deciding.  Changes below the cutoff do not travel on.  Claims that are not live have no old score.
    """
    out: dict[str, list[str]] = {}
    into: dict[str, list[tuple]] = {}
    for e in sorted(edges):
        out.setdefault(e[3], []).append(e[2])
    for e in sorted(edges, key=lambda e: (e[1], e)):
        into.setdefault(e[2], []).append(e)
    for root, score in changes:
        moved = {root: score}
        for at, c in enumerate(revisit_order(out, root)):
            if c not in claims:
                yield root, c, None, None, False, at, False
                continue
            old, material, critical = claims[c]
            hit = [e for e in into.get(c, ()) if e[3] in moved]
            new = old
            if hit and c in combos:
                kind, leak = combos[c]
                parents = {e[3]: (e[6], moved.get(e[3], claims[e[3]][0] if e[3] in claims else None)) for e in into[c]}
                product = 1.0
                for strength, p in parents.values():
                    if p is not None:
                        product *= strength * p + (1 - strength) if kind == "noisy-and" else 1 - strength * p
                new = leak + (1 - leak) * product if kind == "noisy-and" else 1 - (1 - leak) * product
            elif hit:
                last = hit[-1]
                new = last[4] * moved[last[3]] + last[5] * (1.0 - moved[last[3]])
            if not hit or abs(new - old) < cutoff:
                yield root, c, old, old, False, at, False
                continue
            moved[c] = new
            yield root, c, old, new, bool(abs(new - old) >= material or critical), at, True


def propagate(claims: dict[str, tuple], edges: list[tuple], combos: dict[str, tuple], root: str, score: float, cutoff: float = CUTOFF) -> list[tuple]:
    """(claim_id, old, new, flagged, position) of the claims that move when root's score becomes ``score`` (see passes)."""
    return [x[1:6] for x in passes(claims, edges, combos, [(root, score)], cutoff) if x[6]]


_VISITS = "root string, claim_id string, old double, new double, flagged boolean, position int, moved boolean"


def _visited(rows: Iterator[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _VISITS.split(", ")])


def _tables(nodes: pa.Table, edges: pa.Table) -> tuple[dict, dict, list]:
    cols = lambda t, *names: zip(*(t.column(n).to_pylist() for n in names))
    known = {c: (s, m, k) for c, s, m, k in cols(nodes, "claim_id", "score", "materiality", "critical") if s is not None}
    joint = {c: (k, leak) for c, k, leak in cols(nodes, "claim_id", "combo", "leak") if k}
    links = [(seq, us or 0, *rest) for seq, us, *rest in cols(edges, "seq", "from_us", "claim_id", "supports_id", "p_given", "p_given_not", "strength")]
    return known, joint, links


def visits(claims: DataFrame, edges: DataFrame, roots: DataFrame, combos: DataFrame | None = None, *, cutoff: float = CUTOFF) -> DataFrame:
    """``root, claim_id, old, new, flagged, position, moved`` of every claim that each hypothetical change (root, score) visits.

    claims: claim_id, score, materiality, critical (live ones, each once); edges: claim_id, supports_id, p_given,
    p_given_not, strength, from_us, seq; combos: claim_id, combo, leak.  The order of visits is part of the result, so
    each root is one walk; walks of different roots run in parallel.  A graph of a proven bounded size is sent to the
    tasks whole; of a larger one every walk sees only the part that its root reaches, found by distributed joins first,
    and that part may hold at most KERNEL_EDGES edges.
    """
    spark = claims.sparkSession
    e = cut(edges.select("claim_id", "supports_id", "p_given", "p_given_not", "strength", "from_us", "seq").where("claim_id IS NOT NULL AND supports_id IS NOT NULL"))
    r = roots.select(F.col("root").cast("string").alias("root"), F.col("score").cast("double").alias("to")).where("root IS NOT NULL")
    combo = combos if combos is not None else claims.select("claim_id", F.lit(None).cast("string").alias("combo"), F.lit(None).cast("double").alias("leak")).limit(0)
    state = claims.select("claim_id", "score", "materiality", "critical")
    ends = e.select("claim_id").union(e.select("supports_id"))
    if e.limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES:
        nodes = state.join(ends.distinct(), "claim_id", "left_semi").join(combo.select("claim_id", "combo", "leak"), "claim_id", "left")
        shared = spark.sparkContext.broadcast((nodes.toArrow(), e.toArrow()))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = None
            for b in batches:
                if b.num_rows:
                    known = known or _tables(*shared.value)
                    changes = list(zip(b.column("root").to_pylist(), b.column("to").to_pylist()))
                    for rows in batched(passes(known[0], known[2], known[1], changes, cutoff), ROWS):
                        yield _visited(iter(rows))

        return r.mapInArrow(walk, _VISITS)
    near = reach(e, "supports_id", "claim_id", r.select("root")).select("root", F.col("node").alias("claim_id"))
    part = cut(near.join(e, "claim_id"))
    size = part.groupBy("root").count().agg(F.max("count")).first()[0] or 0
    if size > KERNEL_EDGES:
        raise ValueError(f"a root reaches {size} edges; more than {KERNEL_EDGES} do not fit one walk")
    nodes = part.select("root", "claim_id").union(part.select("root", F.col("supports_id"))).distinct().join(state, "claim_id", "left")
    nodes = nodes.join(combo.select("claim_id", "combo", "leak"), "claim_id", "left").join(r, "root")

    def one(n: pa.Table, e: pa.Table) -> pa.Table:
        if not len(n):
            return pa.Table.from_batches([_visited(iter(()))])
        known, joint, links = _tables(n, e)
        return pa.Table.from_batches([_visited(passes(known, links, joint, [(n.column("root")[0].as_py(), n.column("to")[0].as_py())], cutoff))])

    return cut(nodes).groupBy("root").cogroup(part.groupBy("root")).applyInArrow(one, _VISITS)


def revisit(claims: DataFrame, edges: DataFrame, roots: DataFrame, combos: DataFrame | None = None, *, cutoff: float = CUTOFF) -> DataFrame:
    """``root, claim_id, old, new, flagged, position`` of the claims that move, for each change in ``roots`` (see visits)."""
    return visits(claims, edges, roots, combos, cutoff=cutoff).where("moved").drop("moved")


def _walkable(claims: DataFrame, edges: DataFrame) -> dict | None:
    """A graph of a proven bounded size as arrays over its nodes and over its edges, these by supporter in the order of visits.

    rank: where an edge stands among all in the order (from_us, seq), then by all else.  None if there are more than KERNEL_EDGES edges.
    """
    e = cut(edges.select(F.col("claim_id").cast("string").alias("claim_id"), F.col("supports_id").cast("string").alias("supports_id"), "p_given", "p_given_not", "strength", "from_us", "seq").where("claim_id IS NOT NULL AND supports_id IS NOT NULL"))
    if e.limit(KERNEL_EDGES + 1).count() > KERNEL_EDGES:
        return None
    ends = e.select("claim_id").union(e.select("supports_id")).distinct()
    state = claims.select(F.col("claim_id").cast("string").alias("claim_id"), F.col("score").cast("double").alias("score"), F.col("materiality").cast("double").alias("materiality"), "critical").where("score IS NOT NULL")
    got, nodes = e.toArrow(), state.join(ends, "claim_id", "left_semi").toArrow()
    t, s = (got.column(c).combine_chunks() for c in ("claim_id", "supports_id"))
    names = pc.unique(pa.concat_arrays([s, t]))
    names = names.take(pc.array_sort_indices(names))
    to, by = (np.asarray(pc.index_in(x, names)).astype(np.int64) for x in (t, s))
    p, q, strength = (np.asarray(pc.fill_null(got.column(c).cast(pa.float64()), np.nan)) for c in ("p_given", "p_given_not", "strength"))
    us, seq = (np.asarray(pc.fill_null(got.column(c).cast(pa.int64()), 0)) for c in ("from_us", "seq"))
    gap = np.asarray(pc.or_(pc.is_null(got.column("p_given")), pc.is_null(got.column("p_given_not"))))
    rest = (strength, q, p, by, to)
    rank = np.empty(len(to), np.int64)
    rank[np.lexsort((*rest, seq, us))] = np.arange(len(to))
    order = np.lexsort((*rest, us, seq, by))
    at = np.asarray(pc.index_in(nodes.column("claim_id").combine_chunks(), names)).astype(np.int64)
    live, score, material, critical = np.zeros(len(names), bool), np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names), bool)
    live[at], score[at] = True, np.asarray(nodes.column("score"))
    material[at], critical[at] = np.asarray(pc.fill_null(nodes.column("materiality"), np.nan)), np.asarray(pc.fill_null(nodes.column("critical"), False))
    first = np.searchsorted(by[order], np.arange(len(names) + 1))
    return {"names": names, "live": live, "score": score, "materiality": material, "critical": critical, "first": first, "to": to[order], "p": p[order], "q": q[order], "gap": gap[order], "rank": rank[order]}


def _tally(g: dict, roots: np.ndarray, to: np.ndarray, cutoff: float, material: float) -> np.ndarray:
    """(4, roots): true moves, moves, both, flags of the walks (see passes, tallies) from some roots, all of them layer by layer.

    Of the supporters of a claim in one layer, those visited before it stand in the layer above or earlier in its own.
    """
    n, first, target, rank, p, q = len(g["live"]), g["first"], g["to"], g["rank"], g["p"], g["q"]
    out = np.zeros((4, len(roots)), np.int64)
    lane, node, begin = np.arange(len(roots)), roots, 1
    seen = np.zeros(len(roots) * n, np.int32)  # the place of each visit: later visits of a walk have larger ones
    seen[lane * n + node] = begin + lane
    cutoffs = (cutoff, 0.0)
    moved, value, best = [np.ones(len(roots), bool)] * 2, [to, to], [np.full(len(roots), -1)] * 2
    while len(node):
        size = first[node + 1] - first[node]
        src = np.repeat(np.arange(len(node)), size)
        e = np.arange(len(src)) + np.repeat(first[node] - (np.cumsum(size) - size), size)
        key = lane[src] * n + target[e]
        at = seen[key]
        old = g["score"][node]
        # Edges to later claims of the same layer, by these: each is final when the next reads it.
        near = np.flatnonzero((at > src + begin) & g["live"][target[e]])
        near = near[np.argsort(at[near], kind="stable")]
        for mv, v, top, least in zip(moved, value, best, cutoffs):
            for x, s, k in zip((at[near] - begin).tolist(), src[near].tolist(), e[near].tolist()):
                if mv[s] and rank[k] > top[x]:
                    if g["gap"][k]:
                        raise ValueError("a claim that moves rests on an edge without p_given or p_given_not")
                    top[x], v[x] = rank[k], p[k] * v[s] + q[k] * (1.0 - v[s])
                    mv[x] = not abs(v[x] - old[x]) < least
        if begin > 1:
            change = np.abs(value[0] - old)
            true = moved[1] & (np.abs(value[1] - old) >= material)
            flag = moved[0] & ((change >= g["materiality"][node]) | g["critical"][node])
            for i, some in enumerate((true, moved[0], true & moved[0], flag)):
                out[i] += np.bincount(lane[some], minlength=len(roots))
        # The next layer: each node where it is first met.
        begin += len(node)
        fresh = np.flatnonzero(at == 0)
        key, src, e = key[fresh], src[fresh], e[fresh]
        seen[key[::-1]] = np.arange(begin + len(key), begin, -1)
        head = np.flatnonzero(seen[key] == np.arange(begin + 1, begin + len(key) + 1))
        seen[key[head]] = begin + np.arange(len(head))
        x, live = seen[key] - begin, g["live"][target[e]]
        lane, node = lane[src[head]], target[e[head]]
        for m, least in enumerate(cutoffs):
            hit = np.flatnonzero(moved[m][src] & live)
            top = np.full(len(node), -1)
            np.maximum.at(top, x[hit], rank[e[hit]])
            last = hit[top[x[hit]] == rank[e[hit]]]
            if g["gap"][e[last]].any():
                raise ValueError("a claim that moves rests on an edge without p_given or p_given_not")
            v, was = np.zeros(len(node)), value[m][src[last]]
            v[x[last]] = p[e[last]] * was + q[e[last]] * (1.0 - was)
            value[m], best[m] = v, top
            moved[m] = (top >= 0) & ~(np.abs(v - g["score"][node]) < least)
    return out


def tallies(claims: DataFrame, edges: DataFrame, roots: DataFrame, *, cutoff: float = CUTOFF, material: float = 0.05) -> DataFrame | None:
    """``root, n_truth, n_revisited, hit, flags`` of each change that moves a claim: what visits() with the cutoff finds against visits() without one, counted.

    n_truth: claims that move by at least ``material`` without a cutoff; n_revisited, flags: claims that move, and are flagged, with it;
    hit: both.  Claims without combos.  Every walk is whole; no visit is ever a row.  None if the graph has more than KERNEL_EDGES edges.
    """
    g = _walkable(claims, edges)
    if g is None:
        return None
    spark = edges.sparkSession
    r = cut(roots.select(F.col("root").cast("string").alias("root"), F.col("score").cast("double").alias("to")).where("root IS NOT NULL"))
    n = r.count()
    lanes = max(1, min(PLACES // max(1, len(g["live"])), -(-n // (4 * spark.sparkContext.defaultParallelism))))
    shared = spark.sparkContext.broadcast(g)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = shared.value
            at = pc.index_in(b.column("root"), g["names"])
            b = b.filter(pc.is_valid(at))
            at, to = np.asarray(at.drop_null()).astype(np.int64), np.asarray(b.column("to"))
            for lo in range(0, len(at), lanes):
                got = _tally(g, at[lo : lo + lanes], to[lo : lo + lanes], cutoff, material)
                some = np.flatnonzero(got[:2].any(axis=0))
                yield pa.RecordBatch.from_arrays([b.column("root").take(pa.array(some + lo)), *(pa.array(x[some]) for x in got)], names=["root", "n_truth", "n_revisited", "hit", "flags"])

    return r.repartition(max(1, -(-n // lanes))).mapInArrow(walk, "root string, n_truth long, n_revisited long, hit long, flags long")
