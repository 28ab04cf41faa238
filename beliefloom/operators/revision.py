"""What a change of belief sets off: reports, events, decisions it touches, resolution of contradictions, trigger quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beliefloom.operators import contradict, graph
from beliefloom.session import cut, release

#: Shortest paths listed for a node, and ids in all listed paths of a report.
PATHS, PATH_IDS = 100, 100_000


def by_attachment(edges: DataFrame) -> DataFrame:
    """edges with the order in which they were attached: the log's seq, or their time where a table has no seq."""
    return edges if "seq" in edges.columns else edges.withColumn("seq", F.col("from_us"))


def report(claims: DataFrame, edges: DataFrame, roots: DataFrame, combos: DataFrame | None = None, *, cutoff: float = graph.CUTOFF) -> tuple[DataFrame, DataFrame]:
    """(moves, summary): what graph.revisit finds, and per root closure_size, n_revisited, n_cutoff and n_flags.

    n_cutoff are the live claims of the closure that did not move by the cutoff, whether their supporters moved or not.
    """
    seen = cut(graph.visits(claims, by_attachment(edges), roots, combos, cutoff=cutoff))
    n = seen.groupBy("root").agg(
        F.count("*").alias("closure_size"), F.count_if("moved").alias("n_revisited"), F.count_if(~F.col("moved") & F.col("old").isNotNull()).alias("n_cutoff"), F.count_if("flagged").alias("n_flags")
    )
    s = roots.select("root").distinct().join(n, "root", "left")
    return seen.where("moved").drop("moved"), s.select("root", *(F.coalesce(c, F.lit(0)).alias(c) for c in n.columns[1:]))


def decisions_affected(moves: DataFrame, decisions: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``root, decision_id`` of decisions whose basis holds a claim that moved, or the root itself."""
    moved = moves.select("root", "claim_id")
    if roots is not None:
        moved = moved.unionByName(roots.select("root", F.col("root").alias("claim_id")))
    basis = decisions.select("decision_id", F.explode("basis").alias("claim_id")).distinct()
    return basis.join(moved.distinct(), "claim_id").select("root", "decision_id").distinct()


def events(moves: DataFrame, summary: DataFrame, actor: str, t: str, because: str | None = "root") -> DataFrame:
    """``root, position, t, actor, type, payload``: the score revisions of a pass in order, then its revisit event, as rows for a log."""
    by = F.col("root") if because else F.lit(None).cast("string")
    revised = F.to_json(F.struct("claim_id", F.col("old").alias("old_score"), F.col("new").alias("new_score"), by.alias("triggering_event_id")))
    m = moves.select("root", "position", F.lit("score_revision").alias("type"), revised.alias("payload"))
    seen = F.to_json(F.struct(F.col("root").alias("fact_id"), "closure_size", "n_revisited", "n_cutoff", "n_flags"))
    s = summary.select("root", F.lit((1 << 31) - 1).alias("position"), F.lit("revisit").alias("type"), seen.alias("payload"))
    return m.unionByName(s).select("root", "position", F.lit(t).alias("t"), F.lit(actor).alias("actor"), "type", "payload")


def ingest_evidence(claims: DataFrame, edges: DataFrame, facts: DataFrame, t: str, combos: DataFrame | None = None, *, actor: str = "system", cutoff: float = graph.CUTOFF) -> tuple[DataFrame, DataFrame]:
    """(events, summary) of facts (claim_id, statement, credence): their asserts with full entrenchment, then what they move.

    claims are the live ones; a fact may be one of them already or be new.
    """
    first = F.to_json(F.struct("claim_id", "statement", F.col("credence").alias("prior"), F.lit(1.0).alias("entrenchment")))
    asserts = facts.select(F.col("claim_id").alias("root"), F.lit(-1).alias("position"), F.lit(t).alias("t"), F.lit(actor).alias("actor"), F.lit("assert").alias("type"), first.alias("payload"))
    moves, summary = report(claims, edges, facts.select(F.col("claim_id").alias("root"), F.col("credence").alias("score")), combos, cutoff=cutoff)
    return asserts.unionByName(events(moves, summary, actor, t)), summary


def manual_score(claims: DataFrame, edges: DataFrame, changes: DataFrame, t: str, combos: DataFrame | None = None, *, actor: str = "human", cutoff: float = graph.CUTOFF) -> tuple[DataFrame, DataFrame]:
    """(events, result) of scores (claim_id, score) that someone sets by hand: an override, then what it moves.

    result: claim_id, old, new, revisited.  Claims that are not live are left out.
    """
    c = changes.join(claims.select("claim_id", F.col("score").alias("old")), "claim_id")
    hand = F.to_json(F.struct("claim_id", F.col("old").alias("old_score"), F.col("score").alias("new_score")))
    first = c.select(F.col("claim_id").alias("root"), F.lit(-1).alias("position"), F.lit(t).alias("t"), F.lit(actor).alias("actor"), F.lit("score_revision").alias("type"), hand.alias("payload"))
    moves, summary = report(claims, edges, c.select(F.col("claim_id").alias("root"), "score"), combos, cutoff=cutoff)
    result = c.join(summary.select(F.col("root").alias("claim_id"), F.col("n_revisited").alias("revisited")), "claim_id").select("claim_id", "old", F.col("score").alias("new"), "revisited")
    return first.unionByName(events(moves, summary, actor, t)), result


def shortest_paths(edges: DataFrame, source: str, target: str, near: DataFrame, most: int = PATHS) -> DataFrame:
    """``root, node, paths``: up to ``most`` shortest paths to each node of near (root, node, distance), in the order of the ids from their ends on.

    One join per layer; a node passes no more than ``most`` paths on, so a layer's rows are bounded by its edges.
    """
    e = edges.select(F.col(source).alias("at"), F.col(target).alias("node")).where("at IS NOT NULL AND node IS NOT NULL").distinct()
    layer = cut(near.select("root").distinct().select("root", F.col("root").alias("node"), F.array("root").alias("back")))
    deep = near.agg(F.max("distance")).first()[0] or 0
    layers, w = [], Window.partitionBy("root", "node").orderBy("back")
    for d in range(1, deep + 1):
        here = near.where(F.col("distance") == d).select("root", "node")
        step = layer.withColumnRenamed("node", "at").join(e, "at").join(here, ["root", "node"]).select("root", "node", F.concat(F.array("node"), "back").alias("back"))
        layer = cut(step.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k"))
        layers.append(layer)
    every = layer.limit(0) if not layers else layers[0]
    for x in layers[1:]:
        every = every.unionByName(x)
    return every.groupBy("root", "node").agg(F.transform(F.array_sort(F.collect_list("back")), F.reverse).alias("paths"))


def impact_report(edges: DataFrame, root: str, decisions: DataFrame, *, max_depth: int | None = None, max_results: int = 1000, most: int = PATHS, ids: int = PATH_IDS) -> tuple[DataFrame, list[str]]:
    """(nodes, reasons): what rests on a claim, ``id, kind, distance, path_count, paths``, and which caps cut the answer.

    path_count is exact (up to 10**15); of the paths up to ``most`` are listed for a node, and of all nodes together, in
    the order (distance, id, kind), no more than ``ids`` ids.
    """
    spark = edges.sparkSession
    r = spark.createDataFrame([(root,)], "root string")
    found = cut(graph.impact(edges, r, decisions).drop("root"))
    nodes, why = graph.capped(found, max_results, max_depth)
    nodes = cut(nodes)
    near = found.where("kind = 'claim'").select(F.lit(root).alias("root"), F.col("id").alias("node"), "distance")
    if max_depth is not None:
        near = near.where(F.col("distance") <= max_depth)
    paths = cut(shortest_paths(edges, "supports_id", "claim_id", near, most).drop("root"))
    own = nodes.where("kind = 'claim'").join(paths.withColumnRenamed("node", "id"), "id").select("id", "kind", F.explode("paths").alias("path"))
    start = paths.unionByName(spark.createDataFrame([(root, [[root]])], paths.schema))
    dec = decisions.select(F.col("decision_id").alias("id"), F.explode("basis").alias("node")).distinct().join(nodes.where("kind = 'decision'").select("id", "distance"), "id")
    dec = dec.join(start, "node").select("id", "distance", F.explode("paths").alias("path")).where(F.size("path") == F.col("distance")).select("id", F.lit("decision").alias("kind"), F.concat("path", F.array("id")).alias("path"))
    w = Window.partitionBy("id", "kind").orderBy(F.reverse("path"))
    every = own.unionByName(dec).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).join(nodes.select("id", "kind", "distance"), ["id", "kind"])
    # At most max_results * most rows, so one task may number them.
    order = Window.orderBy("distance", "id", "kind", "k").rowsBetween(Window.unboundedPreceding, 0)
    listed = every.withColumn("used", F.sum(F.size("path")).over(order)).where(F.col("used") <= ids)
    listed = listed.groupBy("id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("paths"))
    out = cut(nodes.join(listed, ["id", "kind"], "left").select("id", "kind", "distance", "path_count", F.coalesce("paths", F.array().cast("array<array<string>>")).alias("paths")))
    if not out.where(F.col("path_count") > F.size("paths")).isEmpty():
        why.append("paths")
    release(found)
    return out, why


def resolve(log: DataFrame, claims: DataFrame, edges: DataFrame, t: str, *, actor: str = "system", denied: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, events) of a log's declared contradictions, claims live with their effective entrenchment.

    outcomes: event_id, outcome (``held``, ``already``, ``not-live``, ``tie``, ``denied``, ``resolved``), loser, winner,
    old, new.  The less entrenched claim gives way: its score follows the winner's.  ``denied`` are event_ids that a
    policy refuses.  events: event_id, position, type, payload; a tie or a dead claim makes ``contradiction_unresolved``.
    What the loser's new score sets off is found by report() from the resolved rows.
    """
    pair = [F.col("p.claim_a").alias("claim_a"), F.col("p.claim_b").alias("claim_b")]
    said = log.where("type IN ('contradiction', 'contradiction_held')").select("event_id", "type", *pair, F.coalesce("p.p_loser_given_winner", F.lit(0.1)).alias("p_lw"))
    open_ = contradict.open_contradictions(log).select("event_id", F.lit(True).alias("open"))
    held = contradict.held_contradictions(log).select("event_id", F.lit(True).alias("held"))
    c = said.join(open_, "event_id", "left").join(held, "event_id", "left")
    one = claims.select("claim_id", "score", "entrenchment")
    c = c.join(one.withColumnsRenamed({"claim_id": "claim_a", "score": "sa", "entrenchment": "ea"}), "claim_a", "left").join(one.withColumnsRenamed({"claim_id": "claim_b", "score": "sb", "entrenchment": "eb"}), "claim_b", "left")
    no = denied.select("event_id", F.lit(True).alias("no")) if denied is not None else said.select("event_id", F.lit(True).alias("no")).limit(0)
    c = c.join(no, "event_id", "left")
    tie = F.abs(F.col("ea") - F.col("eb")) < contradict.TIE
    what = (
        F.when(F.col("held"), "held").when(F.col("open").isNull(), "already").when(F.col("sa").isNull() | F.col("sb").isNull(), "not-live")
        .when(tie, "tie").when(F.col("no"), "denied").otherwise("resolved")
    )
    first = F.col("ea") < F.col("eb")
    c = c.withColumn("outcome", what).withColumns({
        "loser": F.when(first, F.col("claim_a")).otherwise(F.col("claim_b")), "winner": F.when(first, F.col("claim_b")).otherwise(F.col("claim_a")),
        "old": F.when(first, F.col("sa")).otherwise(F.col("sb")), "sw": F.when(first, F.col("sb")).otherwise(F.col("sa")),
    })
    new = F.col("p_lw") * F.col("sw") + F.col("old") * (1 - F.col("sw"))
    only = lambda x: F.when(F.col("outcome") == "resolved", x)
    c = c.select("event_id", "outcome", only(F.col("loser")).alias("loser"), only(F.col("winner")).alias("winner"), only(F.col("old")).alias("old"), only(new).alias("new"), F.least("ea", "eb").alias("lower"), F.greatest("ea", "eb").alias("upper"))
    c = cut(c)
    id_ = F.col("event_id").alias("contradiction_id")
    done = c.where("outcome = 'resolved'")
    rows = done.select("event_id", F.lit(0).alias("position"), F.lit("score_revision").alias("type"), F.to_json(F.struct(F.col("loser").alias("claim_id"), F.col("old").alias("old_score"), F.col("new").alias("new_score"), F.col("event_id").alias("triggering_event_id"))).alias("payload"))
    rows = rows.unionByName(done.select("event_id", F.lit(1).alias("position"), F.lit("contract").alias("type"), F.to_json(F.struct(id_, "loser", "winner", "old", "new", F.col("lower").alias("loser_entrenchment"), F.col("upper").alias("winner_entrenchment"))).alias("payload")))
    rows = rows.unionByName(done.select("event_id", F.lit(2).alias("position"), F.lit("contradiction_resolved").alias("type"), F.to_json(F.struct(id_, "loser", "winner")).alias("payload")))
    reason = F.when(F.col("outcome") == "tie", "entrenchment tie").otherwise("claim no longer live")
    rows = rows.unionByName(c.where("outcome IN ('tie', 'not-live')").select("event_id", F.lit(0).alias("position"), F.lit("contradiction_unresolved").alias("type"), F.to_json(F.struct(id_, reason.alias("reason"))).alias("payload")))
    rows = rows.unionByName(c.where("outcome = 'denied'").select("event_id", F.lit(0).alias("position"), F.lit("policy_denied").alias("type"), F.to_json(F.struct(id_, F.lit("resolve_contradiction").alias("action"))).alias("payload")))
    return c.drop("lower", "upper"), rows.select("event_id", "position", F.lit(t).alias("t"), F.lit(actor).alias("actor"), "type", "payload")


def trigger_quality(moves: DataFrame, exact: DataFrame, material: float = 0.05) -> DataFrame:
    """``root, n_truth, n_revisited, recall, precision, flags``: moves with the cutoff against moves without one.

    What counts as true is a claim that moves by at least ``material`` if nothing is cut off.  Recall without true cases
    and precision without moves are 1.
    """
    truth = exact.where(F.abs(F.col("new") - F.col("old")) >= material).select("root", "claim_id", F.lit(1).alias("true"))
    got = moves.select("root", "claim_id", F.lit(1).alias("got"), F.col("flagged").cast("int").alias("flag"))
    n = truth.join(got, ["root", "claim_id"], "full_outer").groupBy("root").agg(
        F.count("true").alias("n_truth"), F.count("got").alias("n_revisited"), F.count_if(F.col("true").isNotNull() & F.col("got").isNotNull()).alias("hit"), F.coalesce(F.sum("flag"), F.lit(0)).alias("flags")
    )
    return _shares(n)


def _shares(n: DataFrame) -> DataFrame:
    share = lambda of: F.when(F.col(of) > 0, F.col("hit") / F.col(of)).otherwise(F.lit(1.0))
    return n.select("root", "n_truth", "n_revisited", share("n_truth").alias("recall"), share("n_revisited").alias("precision"), "flags")


def quality(claims: DataFrame, edges: DataFrame, roots: DataFrame, combos: DataFrame | None = None, *, cutoff: float = graph.CUTOFF, material: float = 0.05) -> DataFrame:
    """trigger_quality() of the changes in roots, with the moves counted where they are found (see graph.tallies).

    Claims with combos and graphs beyond graph.KERNEL_EDGES edges take the rows of two passes.
    """
    e = by_attachment(edges)
    n = graph.tallies(claims, e, roots, cutoff=cutoff, material=material) if combos is None else None
    if n is not None:
        return _shares(n)
    return trigger_quality(graph.revisit(claims, e, roots, combos, cutoff=cutoff), graph.revisit(claims, e, roots, combos, cutoff=0.0), material)
