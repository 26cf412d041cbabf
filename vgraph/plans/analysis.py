"""Whole analyses: one wide row for each graph, and the comparison of two groups over all metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vgraph.functions import stats
from vgraph.functions.stats import joined
from vgraph.operators import flow, morphology, paths, topology
from vgraph.plans.workspace import materialize
from vgraph.schema import LABELS


def network_summary(vertices: DataFrame, edges: DataFrame, box: dict) -> DataFrame:
    """One row for each graph's giant component.

    Sizes, duplicates, loops, high degrees, edges by class, paths from the artery-capillary frontier to the nearest vein, minimum cut and
    disjoint paths, interfaces with what paths use of them, saturation, densities of the box and mean ones of its sub-boxes,
    depth, components and major trees of arteries and veins, and mean lengths and diameters by class.
    """
    v, e = (materialize(t, "giant") for t in topology.giant_component(vertices, edges))
    found = paths.frontier_paths(e)
    along = materialize(paths.path_summary(found, e).drop("kinds"), "along")
    cuts = materialize(flow.min_cut(e).drop("cut_edges", "paths"), "cuts")
    ms = morphology.microsegments(e)
    boxes = morphology.densities(ms, box).where("type = 'total'")
    degree = topology.degrees(v, e)
    parts = [
        topology.density(v, e),
        topology.type_counts(e),
        topology.duplicated_edges(e).drop("n_edges"),
        topology.loop_edges(e).select("graph", "n_loops", "pct_loops"),
        degree.groupBy("graph").agg(F.max("degree").alias("max_degree"), F.count_if(F.col("hdn") > 0).alias("n_high"), F.avg((F.col("hdn") > 0).cast("int")).alias("share_high")),
        along.groupBy("graph").agg(F.count("*").alias("n_paths")),
        joined(stats.percentiles(along, "n_edges", ["graph"], {"median_path_edges": 0.5, "p90_path_edges": 0.9}), stats.percentiles(along, "path_length", ["graph"], {"median_path_length": 0.5}), ["graph"], "left"),
        stats.percentiles(along, "capillary_length", ["graph"], {"median_capillary_length": 0.5}),
        topology.saturation(paths.interface_use(topology.interfaces(e), found), cuts),
        cuts.drop("n_disjoint", "n_artery", "n_vein", "n_capillary"),
        cuts.select("graph", *(F.col(f"n_{c}").alias(f"n_cut_{c}") for c in ("artery", "vein", "capillary"))),
        boxes.groupBy("graph").agg(F.avg("volume_density").alias("box_volume_density"), F.avg("length_density").alias("box_length_density")),
        morphology.box_density(ms, box).groupBy("graph").agg(F.sum("volume_density").alias("volume_density"), F.sum("length_density").alias("length_density")),
        morphology.depth_stats(v).select("graph", "mean_depth", "median_depth"),
        *(tree_summary(e, k, name) for k, name in ((2, "artery"), (3, "vein"))),
        by_class(morphology.length_by_class(e), ["mean_length"]),
        by_class(morphology.diameter_by_class(e), ["mean_diameter", "median_diameter", "p5_diameter", "p95_diameter"]),
    ]
    return reduce(lambda a, b: a.join(b, "graph", "left"), parts)


def tree_summary(edges: DataFrame, nkind: int, name: str) -> DataFrame:
    """By graph: components of a class, major ones, their threshold, and the first major tree's edges and vertices with their shares."""
    table, _ = topology.class_components(edges, nkind)
    first = lambda c: F.coalesce(F.max(F.when(F.col("major_tree_id") == 1, F.col(c))), F.lit(0).cast("long"))
    share = lambda c: F.max(F.when(F.col("major_tree_id") == 1, 100 * F.col(c))) / F.sum(c)
    named = {"components": F.count("*"), "major": F.count_if("is_major"), "threshold": F.first("threshold"), "first_edges": first("n_edges"), "first_nodes": first("n_nodes"), "first_pct_edges": share("n_edges"), "first_pct_nodes": share("n_nodes")}
    return table.groupBy("graph").agg(*(c.alias(f"{name}_{k}") for k, c in named.items()))


def tree_table(sizes: DataFrame, edges: DataFrame) -> DataFrame:
    """By graph, as text: major and all components of arteries and veins ("major/all"), and the first major trees' edges and vertices ("n (pct%)")."""
    out = sizes
    for k, name in ((2, "artery"), (3, "vein")):
        t = tree_summary(edges, k, name)
        count = F.format_string("%d/%d", F.col(f"{name}_major"), F.col(f"{name}_components")).alias(f"{name}_trees")
        part = lambda c, name=name: F.when(F.col(f"{name}_first_pct_{c}").isNotNull(), F.format_string("%d (%.1f%%)", F.col(f"{name}_first_{c}"), F.col(f"{name}_first_pct_{c}"))).otherwise("N/A").alias(f"{name}_first_{c}")
        out = out.join(t.select("graph", count, part("edges"), part("nodes")), "graph", "left")
        out = out.na.fill("0/0", [f"{name}_trees"]).na.fill("N/A", [f"{name}_first_edges", f"{name}_first_nodes"])
    return out


def by_class(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (graph, nkind, columns) as one row a graph, a column for each class."""
    return rows.groupBy("graph").agg(*(F.max(F.when(F.col("nkind") == k, F.col(c))).alias(f"{c}_{name}") for c in columns for k, name in LABELS.items()))


def boundary_tests(rows: DataFrame, group: Column, first: str, second: str) -> DataFrame:
    """Welch's test of the percentages of vessel types at boundaries (type, pct) between two groups of rows, by type, with stars and text."""
    known = rows.where("type <> 'unknown'").select("type", "pct", group.alias("group"))
    out = stats.welch(known, "pct", "group", [first, second], ["type"])
    return out.withColumn("stars", stats.p_stars(F.col("p"), 3)).withColumn("p_text", stats.p_class(F.col("p")))


def region_comparison(vertices: DataFrame, edges: DataFrame, group: Column, first: str, second: str) -> DataFrame:
    """Welch's test of two groups of graphs for each metric and vessel type, with stars; ``group`` names a row's group by its graph."""
    from vgraph.schema import label

    e = edges.select(group.alias("group"), label(F.col("nkind")).alias("type"), F.explode(F.create_map(F.lit("length"), F.col("length"), F.lit("diameter"), F.col("diameter"))).alias("metric", "value"))
    ends = topology.degrees(vertices, edges).join(topology.vertex_types(vertices, edges), ["graph", "vid"])
    long = e.select("group", "type", "metric", "value").unionByName(ends.select(group.alias("group"), "type", F.lit("degree").alias("metric"), F.col("degree").cast("double").alias("value")))
    out = stats.welch(long, "value", "group", [first, second], ["metric", "type"])
    return out.withColumn("stars", stats.p_stars(F.col("p"))).withColumn("p_text", stats.p_text(F.col("p")))
