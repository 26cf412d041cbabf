"""Checks of a network's consistency; each returns counts or the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vgraph.functions.geometry import distance, finite_max, segments, total


def radius_consistency(edges: DataFrame, atol: float = 1e-6, rtol: float = 1e-3) -> DataFrame:
    """By graph: edges whose diameter is the largest of their points', within a tolerance, and the largest gap."""
    top = finite_max(F.col("diameters"))
    gap = F.abs(F.col("diameter") - top)
    return edges.groupBy("graph").agg(F.count("*").alias("n"), F.count_if(gap <= atol + rtol * top).alias("n_ok"), F.count_if(top.isNull() | F.col("diameter").isNull()).alias("n_unknown"), F.count_if(F.size("diameters") == 1).alias("n_one_point"), F.max(gap).alias("max_gap"))


def end_diameters(vertices: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """By graph: how far the first and last point's diameters are from their vertices', with a few of the worst edges."""
    v = vertices.select("graph", "vid", F.col("diameter").alias("d"))
    e = edges.where(F.size("diameters") > 0).select("graph", "eid", "src", "dst", F.element_at("diameters", 1).alias("first"), F.element_at("diameters", -1).alias("last"))
    e = e.join(v.toDF("graph", "src", "at_src"), ["graph", "src"]).join(v.toDF("graph", "dst", "at_dst"), ["graph", "dst"])
    e = e.withColumn("gap", F.greatest(F.abs(F.col("first") - F.col("at_src")), F.abs(F.col("last") - F.col("at_dst"))))
    worst = e.where("gap is not null").withColumn("at", F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("gap"), "eid"))).where(F.col("at") <= most).groupBy("graph").agg(F.array_sort(F.collect_list("eid")).alias("examples"))
    return e.groupBy("graph").agg(F.count("*").alias("n"), F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > 1e-6).alias("n_off")).join(worst, "graph", "left")


def end_points(vertices: DataFrame, edges: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Edges with ``ends``: OK_DIRECT, OK_SWAP, BAD_AMBIG (one end fits) or BAD_BOTH."""
    v = vertices.select("graph", "vid", F.struct("x", "y", "z").alias("p"))
    e = edges.where(F.size("points") > 0).join(v.toDF("graph", "src", "a"), ["graph", "src"]).join(v.toDF("graph", "dst", "b"), ["graph", "dst"])
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    near = lambda p, q: distance(p, q) <= tol
    a, b = F.col("a"), F.col("b")
    any_fits = near(first, a) | near(last, b) | near(first, b) | near(last, a)
    kind = F.when(near(first, a) & near(last, b), "OK_DIRECT").when(near(first, b) & near(last, a), "OK_SWAP").when(any_fits, "BAD_AMBIG").otherwise("BAD_BOTH")
    return e.select("graph", "eid", "src", "dst", kind.alias("ends"))


def ranges_adjoin(ranges: DataFrame) -> DataFrame:
    """Edges (eid, start, end), numbered without gaps, whose range of points does not begin where that of the edge before ended.

    Both sides have a row for every edge, so they are merged, whatever size a plan takes them for.
    """
    before = ranges.select((F.col("eid") + 1).alias("eid"), F.col("end").alias("expected"))
    return ranges.hint("merge").join(before, "eid").select(*ranges.columns, "expected").where("expected <> start")


def rescaling(before: DataFrame, after: DataFrame, scale: float, voxel: float = 1.0, tol: float = 1e-6) -> DataFrame:
    """By graph: edges that break an invariant of rescaling: lengths by the factor, sums with one voxel, segments, diameters, points."""
    b = before.select("graph", "eid", F.col("length").alias("l0"), F.col("diameter").alias("d0"), F.col("points").alias("p0"))
    j = after.join(b, ["graph", "eid"])
    off = lambda x, y: F.abs(x - y) > tol * F.greatest(F.abs(y), F.lit(1.0))
    size = F.size("points") - 1
    first = lambda c: F.element_at(c, 1)["x"]
    return j.groupBy("graph").agg(
        F.count("*").alias("n"),
        F.count_if(off(F.col("length"), F.col("l0") * scale)).alias("bad_length"),
        F.count_if(off(total(F.col("lengths2")), total(segments(F.col("points"))))).alias("bad_sum"),
        F.count_if(F.size("lengths2") != size).alias("bad_segments"),
        F.count_if(off(F.col("diameter"), F.col("d0"))).alias("bad_diameter"),
        F.count_if(off(first("points"), first("p0") * scale)).alias("bad_points"),
    )


def straightest(vertices: DataFrame, edges: DataFrame, top: int = 30) -> DataFrame:
    """The edges whose ends are furthest apart for their length, a report of ``top`` rows."""
    v = vertices.select("graph", "vid", F.struct("x", "y", "z").alias("p"))
    e = edges.join(v.toDF("graph", "src", "a"), ["graph", "src"]).join(v.toDF("graph", "dst", "b"), ["graph", "dst"])
    direct = distance(F.col("a"), F.col("b"))
    return e.select("graph", "eid", "length", direct.alias("direct"), F.expr("try_divide(1.0D, nullif(length, 0)) ").alias("inv")).withColumn("ratio", F.col("direct") * F.col("inv")).drop("inv").orderBy(F.desc_nulls_last("ratio"), "graph", "eid").limit(top)


def open_links(links: DataFrame) -> DataFrame:
    """Links (src, dst) by whether both ends are known."""
    return links.agg(F.count_if(F.col("src").isNotNull() & F.col("dst").isNotNull()).alias("n_closed"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("n_open"))


def diameter_scale(vertices: DataFrame, voxel: str, scaled: str, factor: float = 25.0) -> DataFrame:
    """By graph: the largest and median gap between a diameter and a factor times another."""
    gap = F.abs(F.col(scaled) - factor * F.col(voxel))
    return vertices.groupBy("graph").agg(F.max(gap).alias("max_gap"), F.median(gap).alias("median_gap"))


def overview(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """By graph: sizes, total length and nulls."""
    v = vertices.groupBy("graph").agg(F.count("*").alias("n_vertices"))
    e = edges.groupBy("graph").agg(F.count("*").alias("n_edges"), F.sum("length").alias("sum_length"), F.avg("diameter").alias("mean_diameter"), F.count_if(F.col("nkind").isNull()).alias("no_class"), F.sum(F.size("points")).alias("n_points"))
    return v.join(e, "graph", "left")


def synced(vertices: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of ``values`` (graph, vid, more) put on the vertices of the graphs where both have as many; null elsewhere."""
    n = lambda t, name: t.groupBy("graph").agg(F.count("*").alias(name))
    same = n(vertices, "n").join(n(values, "m"), "graph").where("n = m").select("graph")
    keep = values.join(same, "graph", "left_semi").select("graph", "vid", *columns)
    return vertices.drop(*columns).join(keep, ["graph", "vid"], "left")


def inside_volume(vertices: DataFrame, edges: DataFrame, size: tuple[float, float, float]) -> DataFrame:
    """By graph: whether the smallest coordinates of vertices and of points are 0 or more, and the largest within a volume's size."""
    v = vertices.select("graph", F.lit("nodes").alias("of"), "x", "y", "z")
    p = edges.select("graph", F.lit("points").alias("of"), F.explode("points").alias("p")).select("graph", "of", *(f"p.{a}" for a in "xyz"))
    kinds = [(of, end) for of in ("nodes", "points") for end in ("min", "max")]
    ok = {"min": F.least("x", "y", "z") >= 0, "max": (F.col("x") <= size[0]) & (F.col("y") <= size[1]) & (F.col("z") <= size[2])}
    return v.unionByName(p).groupBy("graph").agg(*(F.bool_and(F.when(F.col("of") == of, ok[end])).alias(f"{of}_{end}_ok") for of, end in kinds))
