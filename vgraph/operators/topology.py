"""Degrees, vertex types, frontiers, components and interface counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vgraph.operators import components as cc
from vgraph.plans.workspace import materialize
from vgraph.schema import ARTERY, CAPILLARY, LABELS, label
from vgraph.functions.geometry import penalised


#: Bits of a vertex id; the graph's number lies above.
BITS = 40


def incidence(edges: DataFrame) -> DataFrame:
    """(graph, vid, other, eid, nkind, length, diameter): each edge at both of its ends, a loop twice."""
    rest = ["eid", "nkind", "length", "diameter"]
    return edges.select("graph", F.col("src").alias("vid"), F.col("dst").alias("other"), *rest).unionByName(edges.select("graph", F.col("dst").alias("vid"), F.col("src").alias("other"), *rest))


def duplicated_edges(edges: DataFrame) -> DataFrame:
    """By graph: unordered pairs with several edges, the edges beyond the first and their percentage."""
    pairs = edges.groupBy("graph", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
    out = pairs.groupBy("graph").agg(F.count_if(F.col("n") > 1).alias("n_pairs"), F.sum(F.col("n") - 1).alias("n_extra"), F.sum("n").alias("n_edges"))
    return out.withColumn("pct_extra", 100 * F.col("n_extra") / F.col("n_edges"))


def loop_edges(edges: DataFrame) -> DataFrame:
    """By graph: self-loops, their percentage and their ids."""
    out = edges.groupBy("graph").agg(F.count_if(F.col("src") == F.col("dst")).alias("n_loops"), F.count("*").alias("n_edges"), F.array_sort(F.collect_list(F.when(F.col("src") == F.col("dst"), F.col("eid")))).alias("loop_ids"))
    return out.withColumn("pct_loops", 100 * F.col("n_loops") / F.col("n_edges"))


def edge_types(edges: DataFrame) -> DataFrame:
    """By graph and class: the number and percentage of edges."""
    counts = edges.groupBy("graph", "nkind").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("graph"))).withColumn("type", label(F.col("nkind")))


def type_counts(edges: DataFrame) -> DataFrame:
    """By graph: edges of each class in a column of its own."""
    known = F.col("nkind").isin(list(LABELS))
    return edges.groupBy("graph").agg(*(F.count_if(F.col("nkind") == k).alias(f"n_{v}") for k, v in LABELS.items()), F.count_if(~known | F.col("nkind").isNull()).alias("n_unknown"))


def degrees(vertices: DataFrame, edges: DataFrame, threshold: int = 4) -> DataFrame:
    """(graph, vid, degree, hdn): a loop counts twice, isolated vertices have 0; hdn is the degree from the threshold on, else 0."""
    n = incidence(edges).groupBy("graph", "vid").agg(F.count("*").alias("degree"))
    out = vertices.select("graph", "vid").join(n, ["graph", "vid"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return out.withColumn("hdn", F.when(F.col("degree") >= threshold, F.col("degree")).otherwise(0))


def degree_histogram(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices by graph, vertex type and degree."""
    t = vertex_types(vertices, edges)
    return degrees(vertices, edges).join(t, ["graph", "vid"]).groupBy("graph", "type", "degree").agg(F.count("*").alias("n"))


def density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """By graph: 2 E / (V (V - 1)), NULL for fewer than two vertices."""
    v, e = vertices.groupBy("graph").agg(F.count("*").alias("n_vertices")), edges.groupBy("graph").agg(F.count("*").alias("n_edges"))
    out = v.join(e, "graph", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0).cast("long")))
    return out.withColumn("density", F.when(F.col("n_vertices") > 1, 2 * F.col("n_edges") / (F.col("n_vertices") * (F.col("n_vertices") - 1))))


def touches(edges: DataFrame) -> DataFrame:
    """(graph, vid, artery, vein, capillary): the classes that a vertex's edges have."""
    return incidence(edges).groupBy("graph", "vid").agg(*(F.coalesce(F.bool_or(F.col("nkind") == k), F.lit(False)).alias(v) for k, v in LABELS.items()))


def vertex_types(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, vid, type): artery before vein before capillary, unknown without any."""
    kind = F.when(F.col("artery"), "artery").when(F.col("vein"), "vein").when(F.col("capillary"), "capillary").otherwise("unknown")
    return vertices.select("graph", "vid").join(touches(edges), ["graph", "vid"], "left").select("graph", "vid", kind.alias("type"))


def majority_types(edges: DataFrame) -> DataFrame:
    """(graph, vid, type): the most frequent class of a vertex's edges, the smaller code on a tie, with the degree as a suffix."""
    n = incidence(edges).groupBy("graph", "vid", "nkind").agg(F.count("*").alias("n"))
    best = n.groupBy("graph", "vid").agg(F.min_by("nkind", F.struct(-F.col("n"), F.col("nkind"))).alias("nkind"), F.sum("n").alias("degree"))
    return best.select("graph", "vid", F.concat_ws("_", label(F.col("nkind")), F.col("degree").cast("string")).alias("type"))


def av_sets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The artery and vein vertices by type; no vertex is both."""
    return vertex_types(vertices, edges).where("type in ('artery', 'vein')")


def vertices_of_class(edges: DataFrame, nkind: int) -> DataFrame:
    """The vertices that an edge of the class touches; sets of different classes may overlap."""
    return incidence(edges).where(F.col("nkind") == nkind).select("graph", "vid").distinct()


def frontier(edges: DataFrame) -> DataFrame:
    """The vertices that touch an artery and a capillary."""
    return touches(edges).where("artery and capillary").select("graph", "vid")


def venous(edges: DataFrame) -> DataFrame:
    return touches(edges).where("vein").select("graph", "vid")


def allowed(edges: DataFrame, arteries: bool = True) -> DataFrame:
    return edges if arteries else edges.where(F.coalesce(F.col("nkind") != ARTERY, F.lit(True)))


def with_penalties(edges: DataFrame, artery: float = 1e5, vein: float = 1e5) -> DataFrame:
    return edges.withColumn("w_cap_prior", penalised(F.col("nkind"), F.col("length"), artery, vein))



def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, vid, component): the smallest vid of the graph that edges reach; isolated vertices are their own."""
    return vertices.select("graph", "vid").join(edge_components(edges), ["graph", "vid"], "left").select("graph", "vid", F.coalesce("component", "vid").alias("component"))


def edge_components(edges: DataFrame) -> DataFrame:
    """(graph, vid, component) of the vertices that have an edge to another one; ids may repeat between graphs.

    One task joins a graph of up to ``components.SMALL`` edges between different pairs; larger graphs go through rounds together.
    """
    a, b = F.col("src").cast("long"), F.col("dst").cast("long")
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select("graph", F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct()
    pairs = materialize(pairs, "pairs")
    schema = "graph string, vid long, component long"
    # fewer than one in SMALL of the pairs' number
    large = materialize(pairs.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > cc.SMALL).select("graph"), "large")
    if large.isEmpty():
        return pairs.groupBy("graph").applyInArrow(cc.joined_graph, schema)
    held = pairs.join(F.broadcast(large), "graph", "left_anti").groupBy("graph").applyInArrow(cc.joined_graph, schema)
    graphs = materialize(large.withColumn("g", F.row_number().over(Window.orderBy("graph")) - 1), "graphs")  # one row a large graph
    code = lambda c: (F.shiftleft(F.col("g").cast("long"), BITS) + F.col(c)).alias(c)
    found = cc.connected_components(pairs.join(graphs, "graph").select(code("v"), code("m")), "v", "m")
    low = lambda c: F.col(c).bitwiseAND((1 << BITS) - 1)
    found = found.select(F.shiftright("id", BITS).cast("int").alias("g"), low("id").alias("vid"), low("component").alias("component"))
    return held.unionByName(found.join(graphs, "g").select("graph", "vid", "component"))


def globally_numbered(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that repeat between graphs made unique: by graph number and old id, kept as ``old_vid``."""
    graphs = vertices.select("graph").distinct().withColumn("g", F.dense_rank().over(Window.orderBy("graph")) - 1)
    v = vertices.join(graphs, "graph").withColumn("old_vid", F.col("vid")).withColumn("vid", F.shiftleft(F.col("g").cast("long"), BITS) + F.col("vid")).drop("g")
    e = edges.join(graphs, "graph").withColumns({c: F.shiftleft(F.col("g").cast("long"), BITS) + F.col(c) for c in ("src", "dst")}).drop("g")
    return v, e


def giant_component(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of each graph's component with most vertices, the one of the smallest id on a tie."""
    c = components(vertices, edges)
    best = c.groupBy("graph", "component").agg(F.count("*").alias("n")).groupBy("graph").agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("component"))
    keep = c.join(best, ["graph", "component"]).select("graph", "vid")
    return vertices.join(keep, ["graph", "vid"], "left_semi"), edges.join(keep.withColumnRenamed("vid", "src"), ["graph", "src"], "left_semi")


def class_components(edges: DataFrame, nkind: int, least: int = 10, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The components of a class's edges by graph, and its edges with their component.

    A component is major if it has at least max(``least``, ``share`` of the largest) edges and a branch vertex (degree 3
    or more). Majors are numbered from 1 by falling edges, the smaller component first.
    """
    mine = edges.where(F.col("nkind") == nkind)
    found = edge_components(mine).withColumnRenamed("vid", "src")
    labelled = mine.join(found, ["graph", "src"], "left").withColumn("component", F.coalesce("component", "src"))
    ends = incidence(labelled.select("graph", "src", "dst", "eid", "nkind", "length", "diameter")).groupBy("graph", "vid").agg(F.count("*").alias("degree"))
    of = labelled.select("graph", F.explode(F.array("src", "dst")).alias("vid"), "component").distinct()
    nodes = of.join(ends, ["graph", "vid"]).groupBy("graph", "component").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("degree") >= 3).alias("n_branch"))
    table = labelled.groupBy("graph", "component").agg(F.count("*").alias("n_edges")).join(nodes, ["graph", "component"])
    by_graph = Window.partitionBy("graph")
    table = table.withColumn("threshold", F.greatest(F.lit(float(least)), share * F.max("n_edges").over(by_graph)))
    table = table.withColumn("is_major", (F.col("n_edges") >= F.col("threshold")) & (F.col("n_branch") >= 1)).withColumn("pct_edges", 100 * F.col("n_edges") / F.sum("n_edges").over(by_graph))
    rank = F.row_number().over(by_graph.orderBy(F.desc("is_major"), F.desc("n_edges"), "component"))
    table = table.withColumn("major_tree_id", F.when(F.col("is_major"), rank))
    out = labelled.join(table.select("graph", "component", "is_major", "major_tree_id"), ["graph", "component"])
    return table, out.select("graph", "eid", "src", "dst", "nkind", "length", "component", "is_major", "major_tree_id")


def major_coverage(vertices_or_edges: DataFrame, table: DataFrame) -> DataFrame:
    """By graph: the first major tree's edges and their share of the class, and the number of majors."""
    return table.groupBy("graph").agg(F.count_if("is_major").alias("n_major"), F.max(F.when(F.col("major_tree_id") == 1, F.col("n_edges"))).alias("first_edges"), F.max(F.when(F.col("major_tree_id") == 1, F.col("pct_edges"))).alias("first_pct"), F.sum("n_edges").alias("class_edges"))


def interfaces(edges: DataFrame) -> DataFrame:
    """By graph: how capillaries meet arteries and veins.

    ``attached`` edges have any end in the class's vertices, ``boundary`` edges exactly one; ``beside`` counts the distinct
    other ends of boundary edges, and ``bound`` is the smaller of the two counts.
    """
    t = touches(edges)
    ends = lambda side: t.select("graph", F.col("vid").alias(side), F.col("artery").alias(f"{side}_a"), F.col("vein").alias(f"{side}_v"))
    caps = edges.where(F.col("nkind") == CAPILLARY).join(ends("src"), ["graph", "src"]).join(ends("dst"), ["graph", "dst"])
    n = caps.groupBy("graph").agg(
        F.count("*").alias("capillary_edges"),
        *(F.count_if(F.col(f"src_{k}") | F.col(f"dst_{k}")).alias(f"attached_{name}") for k, name in (("a", "artery"), ("v", "vein"))),
        *(F.count_if(F.col(f"src_{k}") != F.col(f"dst_{k}")).alias(f"boundary_{name}") for k, name in (("a", "artery"), ("v", "vein"))),
    )
    inner = lambda k: F.when(F.col(f"src_{k}") != F.col(f"dst_{k}"), F.when(F.col(f"src_{k}"), F.col("dst")).otherwise(F.col("src")))
    beside = caps.select("graph", F.explode(F.array(F.struct(F.lit("a").alias("k"), inner("a").alias("vid")), F.struct(F.lit("v").alias("k"), inner("v").alias("vid")))).alias("o")).select("graph", "o.*").where("vid is not null").distinct()
    beside = beside.groupBy("graph").agg(F.count_if(F.col("k") == "a").alias("beside_artery"), F.count_if(F.col("k") == "v").alias("beside_vein"))
    nodes = t.groupBy("graph").agg(F.count_if("artery").alias("artery_nodes"), F.count_if("vein").alias("vein_nodes"), F.count_if(F.col("artery") & F.col("capillary")).alias("ac_nodes"), F.count_if(F.col("vein") & F.col("capillary")).alias("vc_nodes"), F.count_if(F.col("artery") & F.col("vein")).alias("av_nodes"))
    return nodes.join(n, "graph", "left").join(beside, "graph", "left").na.fill(0).withColumn("bound", F.least("beside_artery", "beside_vein"))


def saturation(interface: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Interface counts with the number of edge-disjoint paths (graph, n_disjoint) over boundary edges."""
    out = interface.join(disjoint.select("graph", "n_disjoint"), "graph", "left")
    for name in ("artery", "vein"):
        out = out.withColumn(f"saturation_{name}", F.col("n_disjoint") / F.nullif(F.col(f"boundary_{name}"), F.lit(0)))
    return out
