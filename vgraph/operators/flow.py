"""Minimum cuts and edge-disjoint paths between arteries and veins, graph by graph.

Graphs of boxes are small: one task holds each. Graphs of more than ``ONE_TASK`` edges, such as a whole brain,
are worked on by all tasks, in rounds of joins over tables of vertices and edges.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vgraph.plans.workspace import Rounds, materialize

#: Edges up to which one task takes a whole graph.
ONE_TASK = 200_000

CUT = "graph string, cut_value double, n_cut long, n_artery long, n_vein long, n_capillary long, cut_edges array<long>, n_disjoint long, paths array<array<long>>"


def _flow(arcs: list[list], start: set, ends: set) -> tuple[dict, set]:
    """Unit flow by shortest augmenting paths: (flow by edge: +1 from src, -1 from dst), vertices reached at last."""
    out: dict[int, list] = {}
    for k, (a, b) in enumerate(arcs):
        out.setdefault(a, []).append((k, b, 1))
        out.setdefault(b, []).append((k, a, -1))
    flow = dict.fromkeys(range(len(arcs)), 0)
    while True:
        back: dict = {v: None for v in start}
        queue, hit = deque(start), None
        while queue and hit is None:
            u = queue.popleft()
            for k, w, way in out.get(u, ()):
                if w not in back and flow[k] * way < 1:
                    back[w] = (u, k, way)
                    if w in ends:
                        hit = w
                        break
                    queue.append(w)
        if hit is None:
            return flow, set(back)
        while back[hit] is not None:
            u, k, way = back[hit]
            flow[k] += way
            hit = u


def _split(arcs: list[list], flow: dict, start: set, ends: set) -> list[list]:
    """Edge-disjoint paths out of a flow."""
    onward: dict[int, list] = {}
    for k, (a, b) in enumerate(arcs):
        if flow[k]:
            u, w = (a, b) if flow[k] > 0 else (b, a)
            onward.setdefault(u, []).append(w)
    paths = []
    for s in sorted(start):
        while onward.get(s):
            path = [s]
            while path[-1] not in ends and onward.get(path[-1]):
                path.append(onward[path[-1]].pop())
            if path[-1] in ends:
                paths.append(path)
    return paths


def _cut(pdf: pd.DataFrame) -> pd.DataFrame:
    touch = {k: set(pdf.src[pdf.nkind == k]) | set(pdf.dst[pdf.nkind == k]) for k in (2, 3)}
    both = touch[2] & touch[3]
    rows = pdf[pdf.src != pdf.dst].sort_values("eid")
    arcs = rows[["src", "dst"]].values.tolist()
    row = {"graph": pdf.graph.iloc[0], "cut_value": None, "n_cut": None, "n_artery": None, "n_vein": None, "n_capillary": None, "cut_edges": None}
    # edge-disjoint paths run from artery vertices to vein vertices that touch no artery
    flow, side = _flow(arcs, touch[2], touch[3] - both)
    paths = _split(arcs, flow, touch[2], touch[3] - both)
    row |= {"n_disjoint": len(paths), "paths": paths}
    if touch[2] and touch[3]:
        # a vertex that touches both classes joins the terminals by itself, whose edges count as all edges and one, on either side of the cut
        if both:
            _, side = _flow(arcs, touch[2] - both, touch[3] - both)
        cut = rows[[(a in side) != (b in side) for a, b in arcs]] if len(rows) else rows
        row |= {"cut_value": float(len(cut) + len(both) * (len(pdf) + 1)), "n_cut": len(cut), "cut_edges": sorted(cut.eid.tolist())}
        row |= {f"n_{n}": int((cut.nkind == k).sum()) for k, n in ((2, "artery"), (3, "vein"), (4, "capillary"))}
    return pd.DataFrame([row])


def _ranked(rows: DataFrame, vertex: str, order: str) -> DataFrame:
    """Rows numbered at each vertex, whose degree bounds their number."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("graph", vertex).orderBy(order)))


def _levels(starts: DataFrame, free: DataFrame, sinks: DataFrame) -> tuple[DataFrame, bool]:
    """(graph, vid, level): how many free arcs lead to each vertex from the nearest start; and whether a sink is among them, with which they end."""
    seen = Rounds(starts.sparkSession, "level", "graph string, vid long")
    new = seen.add(starts.select("graph", "vid"))
    while not new.isEmpty():
        found = new.withColumnRenamed("vid", "u").join(free, ["graph", "u"]).select("graph", F.col("w").alias("vid")).distinct()
        new = seen.add(found.join(seen.all(), ["graph", "vid"], "left_anti"))
        if not new.join(sinks, ["graph", "vid"], "left_semi").isEmpty():
            return seen.all(), True
    return seen.all(), False


def _blocking(onward: DataFrame) -> DataFrame:
    """(k, f): a blocking flow over arcs (graph, k, way, u, w, at, last) that lead from level at - 1 to level at, those with ``last`` to a sink.

    A token for each arc into a sink walks back to a start. Those that meet at a vertex take different arcs. One that finds none
    goes back over its last arc, which is dead from then on, as all arcs into that vertex are dead or lead a token on; so when no token
    moves, each way from a start to a sink has a full arc. Tokens that arrived are written once.
    """
    spark = onward.sparkSession
    columns = "graph string, token long, u long, depth int, path array<struct<k: long, way: int, w: long>>"
    arrived, dead = Rounds(spark, "arrived", columns), Rounds(spark, "dead", "k long")
    arc = F.struct("k", "way", "w")
    first = onward.where("last").select("graph", F.col("k").alias("token"), "u", (F.col("at") - 1).cast("int").alias("depth"), F.array(arc).alias("path"))
    inner = onward.where("not last").select("graph", "k", "way", "u", "w")
    arrived.add(first.where("depth = 0"))
    dead.add(spark.createDataFrame([], "k long"))
    live = materialize(first.where("depth > 0"), "tokens")
    while not live.isEmpty():
        used = live.select(F.explode("path.k").alias("k")).unionByName(arrived.all().select(F.explode("path.k").alias("k"))).unionByName(dead.all().select("k"))
        here = live.select("graph", F.col("u").alias("w")).distinct()
        options = inner.join(here, ["graph", "w"], "left_semi").join(used, "k", "left_anti").select("graph", F.col("w").alias("u"), F.struct("k", "way", "w").alias("step"), F.col("u").alias("to"), "k")
        moved = _ranked(live, "u", "token").join(_ranked(options, "u", "k").drop("k"), ["graph", "u", "nth"], "left")
        back = F.element_at("path", -1)
        stuck = F.col("step").isNull()
        moved = moved.select(
            "graph",
            "token",
            F.when(stuck, back["w"]).otherwise(F.col("to")).alias("u"),
            F.when(stuck, F.col("depth") + 1).otherwise(F.col("depth") - 1).alias("depth"),
            F.when(stuck, F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.concat("path", F.array("step"))).alias("path"),
            F.when(stuck, back["k"]).alias("dead"),
        )
        moved = materialize(moved, "tokens")
        dead.add(moved.where("dead is not null").select(F.col("dead").alias("k")))
        arrived.add(moved.where("depth = 0 and dead is null").drop("dead"))
        live = moved.where("depth > 0 and size(path) > 0").drop("dead")
    return arrived.all().select(F.explode("path").alias("a")).select("a.k", F.col("a.way").alias("f"))


def _full_flow(edges: DataFrame, starts: DataFrame, sinks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A greatest unit flow as (k, f), f = 1 from src to dst and -1 back, and the (graph, vid) that the starts still reach.

    ``edges`` has (graph, k, src, dst). Each phase adds a blocking flow over the levels of the free arcs, so the shortest way left gets
    longer with each: with capacities of one there are some 2 sqrt(edges) phases at most, and in practice a few.
    """
    spark = edges.sparkSession
    both = edges.select("graph", "k", F.lit(1).alias("way"), F.col("src").alias("u"), F.col("dst").alias("w")).unionByName(edges.select("graph", "k", F.lit(-1).alias("way"), F.col("dst").alias("u"), F.col("src").alias("w")))
    starts, sinks = materialize(starts.select("graph", "vid"), "starts"), materialize(sinks.select("graph", "vid"), "sinks")
    both = both.join(starts.withColumnRenamed("vid", "w"), ["graph", "w"], "left_anti").join(sinks.withColumnRenamed("vid", "u"), ["graph", "u"], "left_anti")
    arcs = materialize(both, "arcs")
    flow = materialize(spark.createDataFrame([], "k long, f int"), "flow")
    while True:
        free = materialize(arcs.join(flow, "k", "left").where(F.coalesce("f", F.lit(0)) * F.col("way") < 1).select("graph", "k", "way", "u", "w"), "free")
        seen, reached = _levels(starts, free, sinks)
        if not reached:
            return flow, seen.select("graph", "vid")
        at = lambda v, name: seen.select("graph", F.col("vid").alias(v), F.col("level").alias(name))
        onward = free.join(at("u", "before"), ["graph", "u"]).join(at("w", "at"), ["graph", "w"]).where("at = before + 1")
        onward = onward.join(sinks.select("graph", F.col("vid").alias("w"), F.lit(True).alias("last")), ["graph", "w"], "left")
        onward = materialize(onward.select("graph", "k", "way", "u", "w", "at", F.coalesce("last", F.lit(False)).alias("last")), "onward")
        flow = materialize(flow.unionByName(_blocking(onward)).groupBy("k").agg(F.sum("f").cast("int").alias("f")).where("f <> 0"), "flow")


def _walked(edges: DataFrame, flow: DataFrame, starts: DataFrame) -> DataFrame:
    """(graph, path): the flow taken apart, by pairing the arcs that enter a vertex with those that leave it."""
    ahead = F.col("f") > 0
    arcs = edges.join(flow, "k").select("graph", "k", F.when(ahead, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(ahead, F.col("dst")).otherwise(F.col("src")).alias("w"))
    arcs = materialize(arcs, "arcs")
    pairs = _ranked(arcs.select("graph", F.col("w").alias("vid"), "k"), "vid", "k").join(_ranked(arcs.select("graph", F.col("u").alias("vid"), F.col("k").alias("next"), F.col("w").alias("to")), "vid", "next"), ["graph", "vid", "nth"])
    pairs = materialize(pairs.select("k", "next", "to"), "pairs")
    steps = Rounds(edges.sparkSession, "walk", "graph string, token long, k long, w long")
    new = steps.add(arcs.join(starts.withColumnRenamed("vid", "u"), ["graph", "u"], "left_semi").select("graph", F.col("k").alias("token"), "k", "w"))
    while not new.isEmpty():
        new = steps.add(new.join(pairs, "k").select("graph", "token", F.col("next").alias("k"), F.col("to").alias("w")))
    ways = steps.all().groupBy("graph", "token").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "w"))), lambda s: s["w"]).alias("rest"))
    return ways.join(arcs.select(F.col("k").alias("token"), "u"), "token").select("graph", F.concat(F.array("u"), "rest").alias("path"))


def _by_rounds(slim: DataFrame) -> DataFrame:
    """The rows of ``_cut`` for graphs of any size."""
    slim = materialize(slim.withColumn("k", F.monotonically_increasing_id()), "slim")
    edges = slim.where("src <> dst")
    ends = slim.select("graph", F.explode(F.array("src", "dst")).alias("vid"), "nkind")
    touch = materialize(ends.groupBy("graph", "vid").agg(F.max(F.col("nkind") == 2).alias("a"), F.max(F.col("nkind") == 3).alias("v")).where("a or v"), "touch")
    veins = touch.where("v and not a")
    flow, _ = _full_flow(edges, touch.where("a"), veins)
    paths = _walked(edges, flow, touch.where("a").select("graph", "vid")).groupBy("graph").agg(F.count("*").alias("n_disjoint"), F.sort_array(F.collect_list("path")).alias("paths"))
    _, side = _full_flow(edges, touch.where("a and not v"), veins)
    on = lambda v: side.select("graph", F.col("vid").alias(v), F.lit(True).alias(f"{v}_in"))
    cut = edges.join(on("src"), ["graph", "src"], "left").join(on("dst"), ["graph", "dst"], "left").where("coalesce(src_in, false) <> coalesce(dst_in, false)")
    of = lambda k, name: F.count_if(F.col("nkind") == k).alias(f"n_{name}")
    cut = cut.groupBy("graph").agg(F.count("*").alias("n_cut"), of(2, "artery"), of(3, "vein"), of(4, "capillary"), F.sort_array(F.collect_list("eid")).alias("cut_edges"))
    kinds = touch.groupBy("graph").agg((F.max("a") & F.max("v")).alias("cuttable"), F.count_if(F.col("a") & F.col("v")).alias("n_both"))
    out = slim.groupBy("graph").agg(F.count("*").alias("n_edges")).join(kinds, "graph", "left").join(cut, "graph", "left").join(paths, "graph", "left")
    shown = lambda c, kind: F.when(F.col("cuttable"), F.coalesce(c, F.lit(0).cast("long") if kind == "long" else F.array().cast(kind)))
    counts = {c: shown(c, "long") for c in ("n_cut", "n_artery", "n_vein", "n_capillary")}
    value = shown("n_cut", "long") + F.col("n_both") * (F.col("n_edges") + 1)
    return out.select("graph", value.cast("double").alias("cut_value"), *(x.alias(c) for c, x in counts.items()), shown("cut_edges", "array<long>").alias("cut_edges"), F.coalesce("n_disjoint", F.lit(0).cast("long")).alias("n_disjoint"), F.coalesce("paths", F.array().cast("array<array<long>>")).alias("paths"))


def min_cut(edges: DataFrame) -> DataFrame:
    """By graph: the minimum cut between artery-touching and vein-touching vertices, its edges by class, and edge-disjoint paths.

    All edges have capacity one. A graph without arteries or veins has no cut (NULL) and no paths (0). A vertex that touches both
    classes adds the terminals' capacity, the number of edges and one, to ``cut_value``, and may lie on either side;
    of paths it is a beginning, not an end. Of several minimum cuts the one nearest to the arteries is given.
    Graphs of more than ``ONE_TASK`` edges have the same cuts and as many paths, found by rounds over all tasks.
    """
    slim = edges.select("graph", "eid", "src", "dst", F.coalesce("nkind", F.lit(-1)).alias("nkind"))
    slim = materialize(slim, "slim")
    # fewer than one in ONE_TASK of the edges' number, so that they may be sent to all tasks
    large = F.broadcast(materialize(slim.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > ONE_TASK).select("graph"), "large"))
    held = slim.join(large, "graph", "left_anti").groupBy("graph").applyInPandas(_cut, CUT)
    return held if large.isEmpty() else held.unionByName(_by_rounds(slim.join(large, "graph", "left_semi")))
