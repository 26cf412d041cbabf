"""Shortest paths from the artery-capillary frontier to the nearest vein, and what lies along them."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vgraph.operators.clip import induced
from vgraph.operators.topology import allowed, av_sets, frontier, touches, venous, with_penalties
from vgraph.plans.workspace import Rounds, materialize

#: Edges up to which one task takes a whole graph.
ONE_TASK = 200_000
#: Arcs between different pairs up to which one task finds all hops of a graph to a part of its targets, and the most arcs times targets of a part.
HOP_TASK, CELLS = 20_000, 500_000
LABEL = "dist double, hops int, target long, after long"
ROW = "struct<dist: double, hops: int, target: long, after: long, new: boolean>"
NEAREST = f"graph string, vid long, {LABEL}, path array<long>"


def _pareto(rows: Column, tol: float) -> Column:
    """Of rows (dist, hops, target, after, new) those within ``tol`` of the least distance that no row is before in distance, and in edges and target."""
    last = lambda kept: F.element_at(kept, -1)
    fewer = lambda kept, x: F.struct(x["hops"], x["target"]) < F.struct(last(kept)["hops"], last(kept)["target"])
    good = lambda kept, x: (F.size(kept) == 0) | ((x["dist"] <= F.get(kept, F.lit(0))["dist"] + tol) & fewer(kept, x))
    return F.aggregate(F.array_sort(rows), F.lit([]).cast(f"array<{ROW}>"), lambda kept, x: F.when(good(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def _near(tol: float):
    def run(arcs: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        """The labels of one graph, nearest first, and the paths of the vertices that are asked for."""
        near: dict[int, list] = {}
        for u, v, w in arcs[["vid", "to", "w"]].itertuples(index=False):
            near.setdefault(u, []).append((v, w))
        heap = [(0.0, 0, v, -1, v) for v in ends.vid[ends.venous]]
        heapq.heapify(heap)
        labels: dict[int, list] = {}
        while heap:
            label = heapq.heappop(heap)
            dist, hops, target, _, v = label
            have = labels.setdefault(v, [])
            if not have or (dist <= have[0][0] + tol and (hops, target) < have[-1][1:3]):
                have.append(label)
                for to, w in near.get(v, ()):
                    heapq.heappush(heap, (dist + w, hops + 1, target, v, to))
        step = {(v, x[1], x[2]): x[3] for v, have in labels.items() for x in have}
        wanted = set(ends.vid[ends.wanted])
        graph, rows = (arcs if len(arcs) else ends).graph.iloc[0], []
        for v, have in labels.items():
            _, hops, target, after, _ = have[-1]
            path = [v] if v in wanted else None
            while path and len(path) <= hops:
                path.append(step[path[-1], hops + 1 - len(path), target])
            rows.append((graph, v, have[0][0], hops, target, after if hops else None, path))
        return pd.DataFrame(rows, columns=["graph", "vid", "dist", "hops", "target", "after", "path"]).astype({"after": "Int64"})

    return run


def _by_buckets(arcs: DataFrame, starts: DataFrame, tol: float) -> DataFrame:
    """(graph, vid, dist, hops, target, after): the labels of ``_near`` for graphs of any size, several to a vertex.

    Labels wait until their distance's bucket is the least one; then those that no known one is before are known and
    go on over all arcs. What is known is written once, a part a round; only waiting labels are written anew.
    """
    spark = arcs.sparkSession
    width = 4 * (arcs.agg(F.percentile_approx("w", 0.5)).first()[0] or 1.0)
    known = Rounds(spark, "label", f"graph string, vid long, {LABEL}")
    empty = known.add(spark.createDataFrame([], known.columns))
    waiting = materialize(starts.select("graph", "vid", F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.col("vid").alias("target"), F.lit(-1).cast("long").alias("after")), "waiting")
    row = lambda new: F.struct("dist", "hops", "target", "after", F.lit(new).alias("new")).alias("row")
    best = lambda rows: rows.groupBy("graph", "vid").agg(_pareto(F.collect_list("row"), tol).alias("rows"))
    while (least := waiting.agg(F.min("dist")).first()[0]) is not None:
        limit = (least // width + 1) * width
        now = waiting.where(F.col("dist") < limit)
        before = known.all().drop("level").join(now.select("graph", "vid").distinct(), ["graph", "vid"], "left_semi") if known.level else empty
        pool = before.select("graph", "vid", row(False)).unionByName(now.select("graph", "vid", row(True)))
        fresh = best(pool).select("graph", "vid", F.explode(F.filter("rows", lambda r: r["new"])).alias("r")).select("graph", "vid", "r.*").drop("new")
        fresh = known.add(fresh)
        onward = fresh.join(arcs, ["graph", "vid"]).select("graph", F.col("to").alias("vid"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("hops") + 1).alias("hops"), "target", F.col("vid").alias("after"))
        # of the labels that come in at a vertex in this round all but the first ones are left at once
        onward = best(onward.select("graph", "vid", row(True))).select("graph", "vid", F.explode("rows").alias("r")).select("graph", "vid", "r.*").drop("new")
        waiting = materialize(waiting.where(F.col("dist") >= limit).unionByName(onward), "waiting")
    every = best(known.all().select("graph", "vid", row(False)))
    return materialize(every.select("graph", "vid", F.explode("rows").alias("r")).select("graph", "vid", "r.*").drop("new"), "labels")


def _chosen(labels: DataFrame) -> DataFrame:
    """Of each vertex's labels the one of fewest edges, with the least distance of all."""
    pick = labels.groupBy("graph", "vid").agg(F.min("dist").alias("dist"), F.min(F.struct("hops", "target", "after")).alias("c"))
    return pick.select("graph", "vid", "dist", "c.hops", "c.target", F.when(F.col("c.hops") > 0, F.col("c.after")).alias("after"))


def _paths(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """(graph, vid, path): the vertices from each chosen one to its target, by pointers that reach twice as far in each round."""
    key = ["graph", "vid", "hops", "target"]
    steps = materialize(labels.where("hops > 0").select(*key, F.col("after").alias("to")), "steps")
    found = Rounds(labels.sparkSession, "place", "graph string, source long, target long, at int, vid long, hops int")
    found.add(chosen.select("graph", F.col("vid").alias("source"), "target", F.lit(0).alias("at"), "vid", "hops"))
    reach = 1
    while not steps.isEmpty():
        here = found.all().where(F.col("hops") >= reach).join(steps, key)
        found.add(here.select("graph", "source", "target", (F.col("at") + reach).alias("at"), F.col("to").alias("vid"), (F.col("hops") - reach).alias("hops")))
        far = steps.select("graph", F.col("vid").alias("to"), (F.col("hops") + reach).alias("hops"), "target", F.col("to").alias("next"))
        steps = materialize(steps.join(far, ["graph", "to", "hops", "target"]).select(*key, F.col("next").alias("to")), "steps")
        reach *= 2
    paths = found.all().groupBy("graph", F.col("source").alias("vid")).agg(F.array_sort(F.collect_list(F.struct("at", "vid"))).alias("places"))
    return paths.select("graph", "vid", F.col("places.vid").alias("path"))


def nearest_venous(edges: DataFrame, weight: str = "length", tol: float = 1e-6, wanted: DataFrame | None = None) -> DataFrame:
    """(graph, vid, dist, hops, target, after, path): for each vertex that reaches a vein, its nearest venous vertex.

    ``dist`` is the least distance; of all paths within ``tol`` of it the one of fewest edges is taken, then that of the smaller target.
    ``after`` is the path's second vertex; ``path`` runs from the vertex to the target and is given for the (graph, vid) in
    ``wanted``. Weights must not be negative; edges without a weight are left out. One task finds the paths of a graph of up to ``ONE_TASK``
    edges; larger ones go through rounds over all tasks, by buckets of distances, with the same rows.
    """
    ends = touches(edges).select("graph", "vid", F.col("vein").alias("venous"))
    if wanted is not None:
        ends = ends.join(wanted.select("graph", "vid", F.lit(True).alias("wanted")).distinct(), ["graph", "vid"], "full_outer").na.fill(False)
    else:
        ends = ends.withColumn("wanted", F.lit(False))
    return _nearest(edges, ends, weight, tol)


def _nearest(edges: DataFrame, ends: DataFrame, weight: str, tol: float) -> DataFrame:
    """``nearest_venous`` of vertices (graph, vid, venous, wanted)."""
    keep = edges.where(F.col(weight).isNotNull() & (F.col("src") != F.col("dst"))).select("graph", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col(weight).cast("double").alias("w"))
    pairs = keep.groupBy("graph", "a", "b").agg(F.min("w").alias("w"))
    arcs = materialize(pairs.select("graph", F.col("a").alias("vid"), F.col("b").alias("to"), "w").unionByName(pairs.select("graph", F.col("b").alias("vid"), F.col("a").alias("to"), "w")), "arcs")
    ends = materialize(ends.where("venous or wanted"), "ends")
    # fewer than one in ONE_TASK of the arcs' number, so that they may be sent to all tasks
    large = F.broadcast(materialize(arcs.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > 2 * ONE_TASK).select("graph"), "large"))
    part = lambda t, how: t.join(large, "graph", how)
    held = part(arcs, "left_anti").groupBy("graph").cogroup(part(ends, "left_anti").groupBy("graph")).applyInPandas(_near(tol), NEAREST)
    if large.isEmpty():
        return held
    ends = part(ends, "left_semi")
    labels = _by_buckets(part(arcs, "left_semi"), ends.where("venous").select("graph", "vid"), tol)
    chosen = _chosen(labels)
    asked = chosen.join(ends.where("wanted").select("graph", "vid"), ["graph", "vid"], "left_semi")
    return held.unionByName(chosen.join(_paths(labels, asked), ["graph", "vid"], "left"))


def frontier_paths(edges: DataFrame, arteries: bool = False, weight: str = "length", tol: float = 1e-6) -> DataFrame:
    """(graph, source, target, dist, path): the shortest path from each frontier vertex to its nearest venous vertex.

    A frontier vertex that touches a vein is its own target. Those that reach none are left out.
    """
    ends = touches(edges).select("graph", "vid", F.col("vein").alias("venous"), (F.col("artery") & F.col("capillary")).alias("wanted"))
    best = _nearest(allowed(edges, arteries), ends, weight, tol)
    return materialize(best.where("path is not null").select("graph", F.col("vid").alias("source"), "target", "dist", "path"), "paths")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, source, at, eid, nkind, length): the edges along paths, the smallest id of parallel ones; none of a path that lacks an edge."""
    pick = edges.groupBy("graph", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min_by(F.struct("eid", "nkind", "length"), "eid").alias("e"))
    pairs = paths.where(F.size("path") > 1).select("graph", "source", F.posexplode(F.zip_with(F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("at", "p"))
    found = pairs.select("graph", "source", "at", "p.*").join(pick, ["graph", "a", "b"], "left")
    # a window holds one path
    whole = F.bool_and(F.col("e").isNotNull()).over(Window.partitionBy("graph", "source"))
    return found.withColumn("whole", whole).where("whole").select("graph", "source", "at", "e.*")


def path_summary(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a path: vertices, edges, length by class (NULL on a path of one vertex), classes in order, what it starts with and holds."""
    along = path_edges(paths, edges)
    of = lambda k: F.sum(F.when(F.col("nkind") == k, F.col("length")).otherwise(0.0))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("at", "nkind"))), lambda s: s["nkind"])
    sums = along.groupBy("graph", "source").agg(F.sum("length").alias("path_length"), of(2).alias("artery_length"), of(3).alias("vein_length"), of(4).alias("capillary_length"), kinds.alias("kinds"), F.count_if(F.col("nkind") == 2).alias("artery_edges"))
    out = paths.join(sums, ["graph", "source"], "left")
    return out.select("graph", "source", "target", "dist", F.size("path").alias("n_nodes"), (F.size("path") - 1).alias("n_edges"), "path_length", "artery_length", "vein_length", "capillary_length", "kinds", F.coalesce("artery_edges", F.lit(0).cast("long")).alias("artery_edges"), F.coalesce(F.get("kinds", F.lit(0)) == 2, F.lit(False)).alias("starts_with_artery"), F.coalesce(F.array_contains("kinds", 2), F.lit(False)).alias("contains_artery"))


def trimmed(summary: DataFrame) -> DataFrame:
    """Full and capillary length of each path, what is removed by keeping capillaries, and its fraction."""
    gone = F.col("path_length") - F.col("capillary_length")
    return summary.select("graph", "source", "path_length", "capillary_length", gone.alias("removed"), F.col("artery_length").alias("removed_artery"), F.col("vein_length").alias("removed_vein"), F.expr("try_divide(path_length - capillary_length, path_length)").alias("removed_fraction"))


def path_counts(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """By graph: frontier and venous vertices, their product, and the distinct sources and targets of paths."""
    f, v = frontier(edges).groupBy("graph").agg(F.count("*").alias("n_frontier")), venous(edges).groupBy("graph").agg(F.count("*").alias("n_venous"))
    p = paths.groupBy("graph").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("target").alias("n_targets"))
    out = f.join(v, "graph", "full_outer").join(p, "graph", "left").na.fill(0)
    return out.withColumn("n_pairs", F.col("n_frontier") * F.col("n_venous"))


def interface_use(interface: DataFrame, paths: DataFrame) -> DataFrame:
    """Interface counts by graph with the frontier vertices that paths begin at or not and the venous ones that they reach or not."""
    used = paths.groupBy("graph").agg(F.count_distinct("source").alias("frontier_used"), F.count_distinct("target").alias("venous_reached"))
    out = interface.join(used, "graph", "left").na.fill(0, ["frontier_used", "venous_reached"])
    return out.withColumn("frontier_unused", F.col("ac_nodes") - F.col("frontier_used")).withColumn("venous_unreached", F.col("vein_nodes") - F.col("venous_reached"))


def compare(edges: DataFrame, first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """A full outer join of two ways to find paths, by source: targets, distances, true lengths and their differences."""
    a, b = (path_summary(p, edges).select("graph", "source", F.col("target").alias(f"target_{n}"), F.col("dist").alias(f"path_len_{n}"), F.col("path_length").alias(f"true_len_{n}"), F.col("n_edges").alias(f"edges_{n}"), F.col("artery_edges").alias(f"artery_edges_{n}")) for p, n in zip((first, second), names, strict=True))
    out = a.join(b, ["graph", "source"], "full_outer")
    x, y = names
    return out.withColumn("delta", F.col(f"path_len_{y}") - F.col(f"path_len_{x}")).withColumn("same_target", F.col(f"target_{x}") == F.col(f"target_{y}")).withColumn("delta_true", F.col(f"true_len_{y}") - F.col(f"true_len_{x}"))


def compare_restricted_weighted(edges: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Paths without arteries by length against paths over all edges by penalised length."""
    return compare(edges, frontier_paths(edges, False, "length", tol), frontier_paths(with_penalties(edges), True, "w_cap_prior", tol), ("restricted", "weighted"))


def compare_with_without(edges: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Paths by length without and with arteries."""
    return compare(edges, frontier_paths(edges, False, "length", tol), frontier_paths(edges, True, "length", tol), ("without", "with"))


def comparison_summary(rows: DataFrame, second: str) -> DataFrame:
    """By graph: how many targets changed, differences by sign, their median and mean, and paths that use arteries."""
    share = lambda c: (100 * F.avg(c.cast("int")))
    d: Column = F.col("delta")
    return rows.groupBy("graph").agg(F.count("*").alias("n"), F.count_if(~F.col("same_target")).alias("n_target_changed"), share(~F.col("same_target")).alias("pct_target_changed"), F.count_if(d != 0).alias("n_nonzero"), F.count_if(d > 0).alias("n_longer"), F.count_if(d < 0).alias("n_shorter"), F.median(d).alias("median_delta"), F.avg(d).alias("mean_delta"), F.count_if(F.col(f"artery_edges_{second}") > 0).alias("n_uses_artery"))


def summary_table(rows: DataFrame, graphs: list[str]) -> DataFrame:
    """Metrics as rows and graphs as columns, numbers as text and missing ones as NA."""
    metrics = [c for c in rows.columns if c != "graph"]
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(F.format_string("%.3f", F.col(m).cast("double")), F.lit("NA")).alias("value")) for m in metrics))).alias("c")
    return rows.select("graph", cells).select("graph", "c.*").groupBy("metric").pivot("graph", graphs).agg(F.first("value")).na.fill("NA")


def _hops(both: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph, pack, vid, mask, level) and (graph, pack, bit, target): which targets are so many edges away, 64 of them to a mask.

    Breadth-first from all targets at once: a round sends a vertex's mask over its arcs and keeps the bits that are new there. A round's
    rows are written once.
    """
    place = Window.partitionBy("graph", "bucket").orderBy("vid")
    # numbered within ranges of ids, so that no window holds a whole graph
    numbered = targets.select("graph", "vid", F.floor(F.col("vid") / 4096).alias("bucket")).distinct().withColumn("nth", F.row_number().over(place) - 1)
    pack = (F.col("bucket") * 64 + F.floor(F.col("nth") / 64)).alias("pack")
    packed = materialize(numbered.select("graph", pack, (F.col("nth") % 64).cast("int").alias("bit"), F.col("vid").alias("target")), "packed")
    reached = Rounds(both.sparkSession, "reached", "graph string, pack long, vid long, mask long")
    new = reached.add(packed.select("graph", "pack", F.col("target").alias("vid"), F.expr("shiftleft(1L, bit)").alias("mask")))
    none = F.lit(0).cast("long")
    while not new.isEmpty():
        sent = new.join(both.withColumnRenamed("at", "vid"), ["graph", "vid"]).select("graph", "pack", F.col("to").alias("vid"), "mask", none.alias("old"))
        known = reached.all().select("graph", "pack", "vid", none.alias("mask"), F.col("mask").alias("old"))
        fresh = sent.unionByName(known).groupBy("graph", "pack", "vid").agg(F.expr("bit_or(mask) & ~bit_or(old)").alias("mask")).where("mask <> 0")
        new = reached.add(fresh)
    return reached.all(), packed


def _arcs(edges: DataFrame) -> DataFrame:
    both = edges.select("graph", F.col("src").alias("at"), F.col("dst").alias("to")).union(edges.select("graph", "dst", "src"))
    return materialize(both.where("at <> to").distinct(), "arcs")


def _pairs(reached: DataFrame, packed: DataFrame, sources: DataFrame) -> DataFrame:
    """(graph, source, target, pack, bit, hops): the targets of each source."""
    found = reached.where("level > 0").join(sources.select("graph", "vid").distinct(), ["graph", "vid"], "left_semi")
    bits = F.explode(F.expr("filter(sequence(0, 63), b -> (mask & shiftleft(1L, b)) <> 0)")).alias("bit")
    return found.select("graph", "pack", F.col("vid").alias("source"), F.col("level").alias("hops"), bits).join(packed, ["graph", "pack", "bit"])


def _walk(walked: bool):
    def run(arcs: pa.Table, ends: pa.Table) -> pa.Table:
        """The pairs of a small graph's sources and targets with their hops and, if asked for, paths: all targets are searched from at once."""
        at, to, vid = arcs["at"].to_numpy(), arcs["to"].to_numpy(), ends["vid"].to_numpy()
        ids = np.unique(at)
        order = np.lexsort((to, at))
        at, to = np.searchsorted(ids, at[order]), np.searchsorted(ids, to[order])
        # both directions of an arc are there, so each vertex has its arcs in a row, by rising ends
        first = np.flatnonzero(np.diff(at, prepend=-1))
        is_target = ends["target"].to_numpy(zero_copy_only=False)
        place = lambda of: np.searchsorted(ids, np.unique(vid[of & np.isin(vid, ids)]))
        sources, targets = place(~is_target), place(is_target)
        left = np.full((len(ids), len(targets)), -1, np.int32)
        left[targets, np.arange(len(targets))] = 0
        new, level = left == 0, 0
        while new.any():
            level += 1
            new = np.logical_or.reduceat(new[to], first, 0) & (left < 0)
            left[new] = level
        s, t = np.nonzero(left[sources] > 0)
        s = sources[s]
        hops = left[s, t]
        rows = {"source": ids[s], "target": ids[targets[t]], "hops": hops}
        if walked and len(s):
            onward = np.minimum.reduceat(np.where(left[to] == left[at] - 1, to[:, None], len(ids)), first, 0)
            starts = np.append(0, np.cumsum(hops + 1))
            path, here, begin = np.zeros(starts[-1], np.int64), s, starts[:-1]
            for k in range(hops.max() + 1):
                path[begin + k] = ids[here]
                more = hops > k
                here, t, begin, hops = onward[here[more], t[more]], t[more], begin[more], hops[more]
            rows["path"] = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(path))
        elif walked:
            rows["path"] = pa.array([], pa.list_(pa.int64()))
        graph = (arcs if arcs.num_rows else ends)["graph"][0].as_py()
        return pa.table({"graph": pa.array([graph] * len(rows["source"]), pa.string()), **rows})

    return run


def _split(edges: DataFrame, sources: DataFrame, targets: DataFrame, walked: bool) -> tuple[DataFrame, tuple | None]:
    """(graph, source, target, hops, path) of the graphs that a task can hold; and arcs, sources and targets of larger ones, if there are any.

    A graph's targets are dealt in parts, each with all arcs and sources.
    """
    both = _arcs(edges)
    sources, targets = sources.select("graph", "vid").distinct(), targets.select("graph", "vid").distinct()
    arcs = both.groupBy("graph").agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("n")))
    size = arcs.join(targets.groupBy("graph").agg(F.count("*").alias("n_targets")), "graph")
    size = materialize(size.select("graph", (F.col("n") <= HOP_TASK).alias("held"), most.alias("most"), F.floor((F.col("n_targets") - 1) / most).alias("last")), "sizes")
    every = lambda rows: rows.join(size.where("held"), "graph").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    nth = F.row_number().over(Window.partitionBy("graph").orderBy("vid")) - 1
    ends = targets.join(size.where("held"), "graph").select("graph", F.floor(nth / F.col("most")).alias("part"), "vid", F.lit(True).alias("target"))
    ends = ends.unionByName(every(sources).select("graph", "part", "vid", F.lit(False).alias("target")))
    grouped = (t.groupBy("graph", "part") for t in (every(both).select("graph", "part", "at", "to"), ends))
    found = next(grouped).cogroup(next(grouped)).applyInArrow(_walk(walked), "graph string, source long, target long, hops int" + ", path array<long>" * walked)
    large = size.where("not held")
    if large.isEmpty():
        return found, None
    return found, tuple(t.join(large.select("graph"), "graph", "left_semi") for t in (both, sources, targets))


def hop_distances(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(graph, source, target, hops): the fewest edges, one at least, from each source to each target (graph, vid) that it reaches.

    A source is no target of its own. One task takes a graph of up to ``HOP_TASK`` arcs, larger ones go through rounds.
    """
    found, large = _split(edges, sources, targets, False)
    if large is None:
        return found
    both, sources, targets = large
    return found.unionByName(_pairs(*_hops(both, targets), sources).select("graph", "source", "target", "hops"))


def hop_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(graph, source, target, path): a path with fewest edges, of two vertices or more, from each source to each target (graph, vid).

    Of equal paths the lexicographically smallest. Only the pairs (graph, source, target) in ``asked`` are given, all if there is none. One
    task takes a graph of up to ``HOP_TASK`` arcs. Larger ones go through rounds: each goes on to the smallest neighbour that is one edge
    nearer to the target, by the masks of the search.
    """
    key = ["graph", "source", "target"]
    if asked is not None:
        asked = materialize(asked.select(*key).distinct(), "asked")
        sources, targets = (t.join(asked.select("graph", F.col(c).alias("vid")).distinct(), ["graph", "vid"], "left_semi") for t, c in ((sources, "source"), (targets, "target")))
    found, large = _split(edges, sources, targets, True)
    found = found.select(*key, "path")
    found = found if asked is None else found.join(asked, key, "left_semi")
    if large is None:
        return found
    both, sources, targets = large
    reached, packed = _hops(both, targets)
    pairs = _pairs(reached, packed, sources)
    if asked is not None:
        pairs = pairs.join(asked, key, "left_semi")
    steps = Rounds(edges.sparkSession, "walked", "graph string, source long, target long, pack long, bit int, hops int, vid long")
    new = steps.add(pairs.select(*key, "pack", "bit", "hops", F.col("source").alias("vid")))
    while not new.isEmpty():
        ahead = new.where("hops > 0").join(both.withColumnRenamed("at", "vid"), ["graph", "vid"]).select(*key, "pack", "bit", (F.col("hops") - 1).alias("level"), F.col("to").alias("vid"))
        near = ahead.join(reached, ["graph", "pack", "vid", "level"]).where("(mask & shiftleft(1L, bit)) <> 0")
        new = steps.add(near.groupBy(*key, "pack", "bit", F.col("level").alias("hops")).agg(F.min("vid").alias("vid")))
    walks = steps.all().groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("level", "vid"))).alias("places"))
    return found.unionByName(walks.select(*key, F.col("places.vid").alias("path")))


def box_paths(vertices: DataFrame, edges: DataFrame, box: dict) -> DataFrame:
    """``hop_paths`` from all artery to all vein vertices of the edges that lie in the box with both ends; ids stay those of the whole graph."""
    v, e = induced(vertices, edges, box)
    e = materialize(e.select("graph", "eid", "src", "dst", "nkind", "length", "diameter"), "box")
    sets = av_sets(v, e)
    return hop_paths(e, sets.where("type = 'artery'"), sets.where("type = 'vein'"))


def sample_paths(paths: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n paths of each graph at most: those of the smallest sources and targets, or with a seed those of the smallest hashes."""
    order = [F.xxhash64(F.lit(seed), "source", "target")] if seed is not None else []
    nth = F.row_number().over(Window.partitionBy("graph").orderBy(*order, "source", "target"))
    return paths.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")
