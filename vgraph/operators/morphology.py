"""Length and diameter statistics, boundary faces, high-degree vertices, microsegments and densities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vgraph.functions.geometry import distance
from vgraph.functions.stats import joined, percentiles
from vgraph.operators.topology import degrees, incidence, vertex_types
from vgraph.plans.workspace import materialize
from vgraph.schema import DEPTH_BINS, FACES, LABELS, check_box, label


def length_by_class(edges: DataFrame) -> DataFrame:
    """By graph and class: n, sum, mean, median and standard deviation of the length and the class's share of all length."""
    keys = ["graph", "nkind"]
    edges = materialize(edges.select(*keys, "length"), "lengths")
    out = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("length").alias("sum_length"), F.avg("length").alias("mean_length"), F.stddev_samp("length").alias("std_length"))
    out = joined(out, percentiles(edges, "length", keys, {"median_length": 0.5}), keys, "left").select(*keys, "n", "sum_length", "mean_length", "median_length", "std_length")
    return out.withColumn("pct_length", 100 * F.col("sum_length") / F.sum("sum_length").over(Window.partitionBy("graph")))


def diameter_by_class(edges: DataFrame, ranges: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """By graph and class: n, mean, median, 5th and 95th percentile of the diameter, and the percentage in a closed range."""
    d = F.col("diameter")
    inside = F.lit(None).cast("boolean")
    for k, (a, b) in (ranges or {}).items():
        inside = F.when(F.col("nkind") == k, d.between(a, b)).otherwise(inside)
    keys = ["graph", "nkind"]
    edges = materialize(edges.select(*keys, "diameter"), "diameters").where(d.isNotNull())
    out = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diameter"), (100 * F.avg(inside.cast("int"))).alias("pct_in_range"))
    found = percentiles(edges, "diameter", keys, {"median_diameter": 0.5, "p5_diameter": 0.05, "p95_diameter": 0.95})
    return joined(out, found, keys, "left").select(*keys, "n", "mean_diameter", "median_diameter", "p5_diameter", "p95_diameter", "pct_in_range")


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, 5th percentile, median and 95th percentile of a value by keys."""
    rows = materialize(df.select(*keys, value), "values").where(F.col(value).isNotNull())
    return joined(rows.groupBy(*keys).agg(F.count("*").alias("n")), percentiles(rows, value, keys, {"p5": 0.05, "median": 0.5, "p95": 0.95}), keys, "left")


def share_at_least(df: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(value) >= least).cast("int")).alias("share"))


def face_distances(vertices: DataFrame, box: dict) -> DataFrame:
    """Six rows a vertex: its distance to each face's plane, and whether it lies in the face's bounds on the other axes."""
    check_box(box)
    rows = []
    for name, axis, key in FACES:
        others = [F.col(a).between(box[f"{a}min"], box[f"{a}max"]) for a in "xyz" if a != axis]
        rows.append(F.struct(F.lit(name).alias("face"), F.abs(F.col(axis) - box[key]).alias("gap"), (others[0] & others[1]).alias("within")))
    return vertices.select("*", F.explode(F.array(*rows)).alias("f")).select(*vertices.columns, "f.*")


def face_vertices(vertices: DataFrame, box: dict, eps: float) -> DataFrame:
    """(graph, vid, face): vertices on a face's plane; one at an edge of the box has several faces."""
    return face_distances(vertices, box).where((F.col("gap") <= eps) & F.col("within")).select("graph", "vid", "face")


def border_faces(vertices: DataFrame) -> DataFrame:
    """(graph, vid, face) of vertices that were marked when the network was cut."""
    return vertices.where("is_border = 1 and border_face is not null").select("graph", "vid", F.col("border_face").alias("face"))


def near_planes(vertices: DataFrame, box: dict, eps: float) -> DataFrame:
    """By graph and face: the smallest distance to the plane and the vertices within the tolerance."""
    return face_distances(vertices, box).groupBy("graph", "face").agg(F.min("gap").alias("min_gap"), F.count_if(F.col("gap") <= eps).alias("n_near"))


def vertex_diameters(edges: DataFrame) -> DataFrame:
    """(graph, vid, diameter): the mean of a vertex's distinct edges; NULL if none is known."""
    return incidence(edges).dropDuplicates(["graph", "vid", "eid"]).groupBy("graph", "vid").agg(F.avg("diameter").alias("edge_diameter"))


def boundary(vertices: DataFrame, edges: DataFrame, faces: DataFrame) -> DataFrame:
    """One row for each vertex on a face: its type, degree, mean edge diameter and depth."""
    keys = ["graph", "vid"]
    return faces.join(vertex_types(vertices, edges), keys).join(degrees(vertices, edges), keys).join(vertex_diameters(edges), keys, "left").join(vertices.select(*keys, "distance_to_surface"), keys)


def boundary_stats(rows: DataFrame, threshold: int = 4) -> DataFrame:
    """By graph, face and type: count, share of the face, high degrees, and diameters."""
    out = rows.groupBy("graph", "face", "type").agg(F.count("*").alias("n"), F.count_if(F.col("degree") >= threshold).alias("n_high"), F.avg("edge_diameter").alias("mean_diameter"), F.median("edge_diameter").alias("median_diameter"), F.stddev_samp("edge_diameter").alias("std_diameter"))
    return out.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("graph", "face")))


def boundary_depths(rows: DataFrame) -> DataFrame:
    """By graph and face: n, min, mean, median and max depth of the face's vertices."""
    known = materialize(rows.select("graph", "face", "distance_to_surface"), "depths").where("distance_to_surface is not null")
    d, keys = F.col("distance_to_surface"), ["graph", "face"]
    out = known.groupBy(*keys).agg(F.count(d).alias("n"), F.min(d).alias("min_depth"), F.avg(d).alias("mean_depth"), F.max(d).alias("max_depth"))
    return joined(out, percentiles(known, "distance_to_surface", keys, {"median_depth": 0.5}), keys, "left")


def boundary_table(rows: DataFrame) -> DataFrame:
    """By graph and face, all six of them: vertices of each type, zeros filled in."""
    faces = rows.sparkSession.createDataFrame([(f[0],) for f in FACES], "face string")
    grid = rows.select("graph").distinct().crossJoin(F.broadcast(faces))
    counts = rows.groupBy("graph", "face").pivot("type", ["artery", "vein", "capillary", "unknown"]).count()
    return grid.join(counts, ["graph", "face"], "left").na.fill(0)


def boundary_by_graph(rows: DataFrame, graphs: list[str]) -> DataFrame:
    """A row a face with a count for each of the named graphs."""
    return rows.groupBy("face").pivot("graph", graphs).count().na.fill(0)


def boundary_pooled(rows: DataFrame) -> DataFrame:
    """By graph and type, unknown left out: n, mean, median and deviation of diameters, total and percentage."""
    known = rows.where("type <> 'unknown'")
    out = known.groupBy("graph", "type").agg(F.count("*").alias("n"), F.avg("edge_diameter").alias("mean"), F.median("edge_diameter").alias("median"), F.stddev_samp("edge_diameter").alias("std"))
    return out.withColumn("total", F.sum("n").over(Window.partitionBy("graph"))).withColumn("pct", 100 * F.col("n") / F.col("total"))


def depth_stats(vertices: DataFrame, depth: str = "distance_to_surface", bins: tuple = DEPTH_BINS) -> DataFrame:
    """By graph: n, min, mean, median and max depth, and counts and shares in half-open bins."""
    d = F.col(depth)
    aggs = [F.count(d).alias("n"), F.min(d).alias("min_depth"), F.avg(d).alias("mean_depth"), F.max(d).alias("max_depth")]
    for i, (_, a, b) in enumerate(bins):
        inside = (d >= a) & (d < b) if b < math.inf else d >= a
        aggs += [F.count_if(inside).alias(f"n_bin{i}"), F.avg(inside.cast("int")).alias(f"share_bin{i}")]
    known = materialize(vertices.select("graph", depth), "depths").where(d.isNotNull())
    return joined(known.groupBy("graph").agg(*aggs), percentiles(known, depth, ["graph"], {"median_depth": 0.5}), ["graph"], "left")


def high_degree(vertices: DataFrame, edges: DataFrame, box: dict, threshold: int = 4, eps: float = 5.0) -> DataFrame:
    """By graph: number and share of high-degree vertices, their types and depths, centroids, mean distances to them, and the largest share near one face."""
    keys = ["graph", "vid"]
    v = vertices.join(degrees(vertices, edges, threshold).select(*keys, (F.col("degree") >= threshold).alias("high")), keys).join(vertex_types(vertices, edges), keys)
    v = materialize(v.select(*keys, "x", "y", "z", "distance_to_surface", "high", "type"), "high")
    high = F.col("high")
    of = lambda a: F.when(high, F.col(a))
    kinds = (F.count_if(high & (F.col("type") == t)).alias(f"n_{t}") for t in LABELS.values())
    depth = (f(of("distance_to_surface")).alias(f"{n}_depth") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max)))
    centre = v.groupBy("graph").agg(F.count("*").alias("n"), F.count_if("high").alias("n_high"), *(F.avg(a).alias(f"all_{a}") for a in "xyz"), *(F.avg(of(a)).alias(f"high_{a}") for a in "xyz"), *kinds, *depth)
    at = lambda p: F.struct(*(F.col(f"{p}{a}").alias(a) for a in "xyz"))
    spread = v.join(centre, "graph").groupBy("graph").agg(F.avg(distance(at(""), at("all_"))).alias("mean_distance_all"), F.avg(F.when(high, distance(at(""), at("high_")))).alias("mean_distance_high"))
    near = face_distances(v.where("high"), box).groupBy("graph", "face").agg(F.avg((F.col("gap") <= eps).cast("int")).alias("share")).groupBy("graph").agg(F.max("share").alias("max_face_share"))
    out = centre.join(spread, "graph").join(near, "graph", "left")
    return out.withColumn("share_high", F.col("n_high") / F.col("n")).withColumn("shift", distance(at("high_"), at("all_"))).withColumn("compactness", F.col("mean_distance_high") / F.nullif(F.col("mean_distance_all"), F.lit(0.0)))


def microsegments(edges: DataFrame) -> DataFrame:
    """One row for each pair of consecutive points: midpoint, length, class and the radii at both ends.

    Diameters by point are used if there is one for each point, all finite and positive; else the edge's, if positive; else
    the edge has no microsegments. Neither have pairs of equal points.
    """
    good = F.coalesce((F.size("diameters") == F.size("points")) & F.forall("diameters", lambda d: F.coalesce((d > 0) & (d < math.inf), F.lit(False))), F.lit(False))
    e = edges.select("graph", "eid", "nkind", "points", F.when(good, F.col("diameters")).alias("ds"), F.when(F.col("diameter") > 0, F.col("diameter")).alias("one"))
    # pairs are taken apart after the explosion, in compiled code
    last = F.size("points") - 2
    m = e.select("*", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("i"))
    r = lambda k: F.coalesce(F.get("ds", F.col("i") + k), F.col("one")) / 2
    m = m.select("graph", "eid", "nkind", "i", F.get("points", "i").alias("a"), F.get("points", F.col("i") + 1).alias("b"), r(0).alias("r0"), r(1).alias("r1"))
    m = m.select("graph", "eid", "i", "nkind", distance(F.col("a"), F.col("b")).alias("length"), "r0", "r1", *(((F.col(f"a.{a}") + F.col(f"b.{a}")) / 2).alias(f"m{a}") for a in "xyz"))
    return m.where("length > 0 and r0 is not null")


def microsegment_counts(ms: DataFrame) -> DataFrame:
    return ms.groupBy("graph", "nkind").agg(F.count("*").alias("n"))


def _volume() -> Column:
    return F.lit(math.pi) * F.pow((F.col("r0") + F.col("r1")) / 2, F.lit(2.0)) * F.col("length")


def sub_boxes(spark, box: dict, size: float = 100.0, stride: float = 50.0) -> DataFrame:
    """(i, j, k, xmin, ..., zmax) of the overlapping boxes of a size that fit into a box, a stride apart."""
    check_box(box)
    out = spark.range(1)
    for a, n in zip("xyz", "ijk", strict=True):
        last = math.floor((box[f"{a}max"] - box[f"{a}min"] - size) / stride + 1e-9)
        out = out.withColumn(n, F.explode(F.sequence(F.lit(0), F.lit(last)) if last >= 0 else F.array().cast("array<int>")))
        out = out.withColumn(f"{a}min", box[f"{a}min"] + F.col(n) * stride).withColumn(f"{a}max", F.col(f"{a}min") + size)
    return out.drop("id")


def densities(ms: DataFrame, box: dict, size: float = 100.0, stride: float = 50.0) -> DataFrame:
    """By graph, sub-box and type, total among them: volume density and length density in mm per mm3, zeros filled in.

    Bounds are closed and boxes overlap, so a midpoint counts in each box that holds it. Along an axis these are boxes in a row; midpoints
    whose rows are the same on all axes are a cell, and planes that bound boxes have cells of their own. Cells are summed
    once, then spread over the boxes of one axis after the other, so work after the first sum follows the number of cells.
    """
    check_box(box)
    last = {a: math.floor((box[f"{a}max"] - box[f"{a}min"] - size) / stride + 1e-9) for a in "xyz"}
    inside = F.lit(True)
    rows = {}
    for a in "xyz":
        at = F.col(f"m{a}") - box[f"{a}min"]
        inside &= F.col(f"m{a}").between(box[f"{a}min"], box[f"{a}max"])
        rows[f"{a}_low"] = F.greatest(F.ceil((at - size) / stride), F.lit(0))
        rows[f"{a}_high"] = F.least(F.floor(at / stride), F.lit(last[a]))
    # midpoints outside keep their graph in the result
    held = ms.withColumns({n: F.when(inside, c) for n, c in rows.items()})
    cells = held.groupBy("graph", label(F.col("nkind")).alias("type"), *rows).agg(F.sum(_volume()).alias("volume"), F.sum("length").alias("sum_length"))
    sums = cells = materialize(cells, "cells")
    for k, (a, n) in enumerate(zip("xyz", "ijk", strict=True)):
        low, high = F.col(f"{a}_low"), F.col(f"{a}_high")
        sums = sums.where(low <= high).withColumn(n, F.explode(F.sequence(low, high)))
        sums = sums.groupBy("graph", "type", *"ijk"[: k + 1], *(f"{b}_{end}" for b in "xyz"[k + 1 :] for end in ("low", "high"))).agg(F.sum("volume").alias("volume"), F.sum("sum_length").alias("sum_length"))
    total = sums.groupBy("graph", "i", "j", "k").agg(F.sum("volume").alias("volume"), F.sum("sum_length").alias("sum_length")).withColumn("type", F.lit("total"))
    grid = cells.select("graph").distinct()
    for a, n in zip("xyz", "ijk", strict=True):
        grid = grid.withColumn(n, F.explode(F.sequence(F.lit(0), F.lit(last[a])) if last[a] >= 0 else F.array().cast("array<int>")))
    grid = grid.withColumn("type", F.explode(F.array(*(F.lit(t) for t in ("total", "artery", "vein", "capillary")))))
    out = grid.join(sums.unionByName(total), ["graph", "i", "j", "k", "type"], "left").na.fill(0.0)
    v = size**3
    return out.select("graph", "i", "j", "k", "type", (F.col("volume") / v).alias("volume_density"), (F.col("sum_length") * 1e-3 / (v * 1e-9)).alias("length_density"))


def box_density(ms: DataFrame, box: dict) -> DataFrame:
    """By graph and class: densities in one box with closed bounds."""
    v = math.prod(box[f"{a}max"] - box[f"{a}min"] for a in "xyz")
    inside = ms.where(" and ".join(f"m{a} between {box[f'{a}min']!r} and {box[f'{a}max']!r}" for a in "xyz"))
    return inside.groupBy("graph", "nkind").agg((F.sum(_volume()) / v).alias("volume_density"), (F.sum("length") * 1e-3 / (v * 1e-9)).alias("length_density"))


def slabs(ms: DataFrame, box: dict, thickness: float, axis: str = "z") -> DataFrame:
    """By graph, slab and type: the volume fraction. Slabs are half-open, the last one closed."""
    n = max(1, math.ceil((box[f"{axis}max"] - box[f"{axis}min"]) / thickness - 1e-9))
    area = math.prod(box[f"{a}max"] - box[f"{a}min"] for a in "xyz" if a != axis)
    at = F.floor((F.col(f"m{axis}") - box[f"{axis}min"]) / thickness)
    inside = ms.where(" and ".join(f"m{a} between {box[f'{a}min']!r} and {box[f'{a}max']!r}" for a in "xyz")).withColumn("slab", F.least(at, F.lit(n - 1)))
    by = inside.groupBy("graph", "slab").pivot("nkind", [2, 3, 4]).agg(F.sum(_volume())).na.fill(0.0)
    parts = {"artery": "2", "vein": "3", "capillary": "4"}
    return by.select("graph", "slab", *((F.col(c) / (area * thickness)).alias(t) for t, c in parts.items()), ((F.col("2") + F.col("3") + F.col("4")) / (area * thickness)).alias("total"))


def bounds(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """By graph: the smallest and largest coordinates of vertices and points."""
    p = edges.select("graph", F.explode("points").alias("p")).select("graph", "p.*")
    return vertices.select("graph", "x", "y", "z").unionByName(p).groupBy("graph").agg(*(f(a).alias(f"{a}{n}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))))
