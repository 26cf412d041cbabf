"""Clipping networks to boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vgraph.functions.geometry import oriented, per_point, segments, total
from vgraph.operators.topology import giant_component
from vgraph.plans.workspace import materialize
from vgraph.schema import FACES, check_box


def inside(p: Column | None, box: dict, pad: float = 0.0) -> Column:
    """Whether a point (or the row's x, y, z) lies in a box with closed bounds."""
    out = F.lit(True)
    for a in "xyz":
        c = F.col(a) if p is None else p[a]
        out = out & c.between(box[f"{a}min"] - pad, box[f"{a}max"] + pad)
    return out


def classify(vertices: DataFrame, edges: DataFrame, box: dict) -> DataFrame:
    """Edges with ``place``: in, across or outside, by their ends alone."""
    v = vertices.select("graph", "vid", inside(None, check_box(box)).alias("in"))
    ends = lambda side: v.select("graph", F.col("vid").alias(side), F.col("in").alias(f"{side}_in"))
    e = edges.join(ends("src"), ["graph", "src"]).join(ends("dst"), ["graph", "dst"])
    return e.withColumn("place", F.when(F.col("src_in") & F.col("dst_in"), "in").when(F.col("src_in") | F.col("dst_in"), "across").otherwise("outside"))


def renumbered(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids from 0 by graph in the order of the old ones, which stay as old_vid and old_eid."""
    v = vertices.withColumn("old_vid", F.col("vid")).withColumn("vid", (F.row_number().over(Window.partitionBy("graph").orderBy("old_vid")) - 1).cast("long"))
    names = v.select("graph", "old_vid", F.col("vid").alias("new"))
    e = edges.withColumn("old_eid", F.col("eid")).withColumn("eid", (F.row_number().over(Window.partitionBy("graph").orderBy("old_eid")) - 1).cast("long"))
    for side in ("src", "dst"):
        e = e.join(names.withColumnRenamed("old_vid", side), ["graph", side]).drop(side).withColumnRenamed("new", side)
    return v, e


def induced(vertices: DataFrame, edges: DataFrame, box: dict, pad: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The vertices in a padded box and the edges with both ends among them."""
    v = vertices.where(inside(None, check_box(box), pad))
    e = edges
    for side in ("src", "dst"):
        e = e.join(v.select("graph", F.col("vid").alias(side)), ["graph", side], "left_semi")
    return v, e


def cut_simple(vertices: DataFrame, edges: DataFrame, box: dict) -> tuple[DataFrame, DataFrame]:
    """The induced network without isolated vertices, its largest component."""
    v, e = induced(vertices, edges, box)
    ends = e.select("graph", F.explode(F.array("src", "dst")).alias("vid")).distinct()
    return giant_component(v.join(ends, ["graph", "vid"], "left_semi"), e)


def crossing(a: Column, b: Column, box: dict) -> Column:
    """Where a segment from an inner to an outer point leaves a box: (x, y, z, face), by x, then y, then z; NULL if nowhere.

    A plane's point counts only if it lies in the box, within 1e-9.
    """
    out = F.lit(None).cast("struct<x: double, y: double, z: double, face: string>")
    for axis in "zyx":
        for end in ("max", "min"):
            plane = box[f"{axis}{end}"]
            over = b[axis] > plane if end == "max" else b[axis] < plane
            t = F.try_divide(F.lit(plane) - a[axis], b[axis] - a[axis])
            p = F.struct(*((F.lit(float(plane)) if c == axis else a[c] + t * (b[c] - a[c])).alias(c) for c in "xyz"), F.lit(f"{axis}_{end}").alias("face"))
            out = F.when(F.coalesce(over & inside(p, box, 1e-9), F.lit(False)), p).otherwise(out)
    return out


def cut(vertices: DataFrame, edges: DataFrame, box: dict, legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """A network clipped to a box.

    Inner edges stay. An edge with one end inside is cut where it first leaves: its points up to there and the
    crossing, at which a new vertex takes the inner one's attributes, with is_border = 1 and its face. Diameters by point are
    cut alike, the last one repeated; lengths are taken anew. Edges with both ends outside go even if they cross the
    box, as do edges of fewer than two points and isolated vertices. ``legacy`` leaves diameters unturned where points are turned.
    """
    e = classify(vertices, edges, box).where("place <> 'outside'").where(F.size("points") > 1)
    at = vertices.select("graph", F.col("vid").alias("src"), F.struct("x", "y", "z").alias("source"))
    e = e.join(at, ["graph", "src"]).withColumn("turn", oriented(F.col("points"), F.col("source"))).drop("source")
    e = e.withColumn("points", F.when(F.col("turn"), F.reverse("points")).otherwise(F.col("points")))
    if not legacy:
        e = e.withColumn("diameters", F.when(F.col("turn"), F.reverse("diameters")).otherwise(F.col("diameters")))
    e = materialize(e, "turned")
    whole = e.where("place = 'in'")
    # walk from the inner end
    c = e.where("place = 'across'").withColumn("near", F.when(F.col("src_in"), F.col("src")).otherwise(F.col("dst")))
    c = c.withColumns({n: F.when(F.col("src_in"), F.col(n)).otherwise(F.reverse(n)) for n in ("points", "diameters")})
    mask = F.transform("points", lambda p: inside(p, box))
    c = c.withColumn("out", F.array_position(mask, F.lit(False)).cast("int")).where("out > 1")
    # written, as the crossing names its two points many times
    c = materialize(c.withColumn("a", F.element_at("points", F.col("out") - 1)).withColumn("b", F.element_at("points", F.col("out"))), "leaving")
    c = materialize(c.withColumn("leave", crossing(F.col("a"), F.col("b"), box)).drop("a", "b").where("leave is not null"), "crossings")
    point = F.struct("leave.x", "leave.y", "leave.z")
    kept = F.concat(F.slice("points", F.lit(1), F.col("out") - 1), F.array(point))
    ds = F.when(F.size("diameters") == F.size("points"), F.concat(F.slice("diameters", F.lit(1), F.col("out") - 1), F.array(F.element_at("diameters", F.col("out") - 1))))
    c = c.withColumn("ds", ds).withColumn("points", kept).withColumn("diameters", F.coalesce("ds", "diameters"))
    top = vertices.groupBy("graph").agg(F.max("vid").alias("top"))
    c = c.join(top, "graph").withColumn("border", F.col("top") + F.row_number().over(Window.partitionBy("graph").orderBy("eid")))
    extra = [n for n in vertices.columns if n not in ("graph", "vid", "x", "y", "z", "is_border", "border_face")]
    near = vertices.select("graph", F.col("vid").alias("near"), *extra)
    new = c.join(near, ["graph", "near"]).select("graph", F.col("border").alias("vid"), "leave.x", "leave.y", "leave.z", *extra, F.lit(1).alias("is_border"), F.col("leave.face").alias("border_face")) if not set(extra) & {"diameter"} else c.drop("diameter").join(near, ["graph", "near"]).select("graph", F.col("border").alias("vid"), "leave.x", "leave.y", "leave.z", *extra, F.lit(1).alias("is_border"), F.col("leave.face").alias("border_face"))
    names = [n for n in edges.columns]
    cut_edges = c.withColumn("src", F.col("near")).withColumn("dst", F.col("border"))
    cut_edges = cut_edges.withColumn("lengths2", segments(F.col("points"))).withColumn("length", total(F.col("lengths2"))).withColumn("lengths", per_point(F.col("lengths2")))
    every = whole.select(names).unionByName(cut_edges.select(names))
    every = materialize(every, "cut")
    old = vertices.drop("is_border", "border_face").where(inside(None, box)).withColumn("is_border", F.lit(0)).withColumn("border_face", F.lit(None).cast("string"))
    v = old.unionByName(new.select(old.columns))
    ends = every.select("graph", F.explode(F.array("src", "dst")).alias("vid")).distinct()
    return v.join(ends, ["graph", "vid"], "left_semi"), every


def border_report(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """By graph, face and degree: border vertices; each should have one edge."""
    from vgraph.operators.topology import degrees

    b = vertices.where("is_border = 1").join(degrees(vertices, edges), ["graph", "vid"])
    return b.groupBy("graph", F.col("border_face").alias("face"), "degree").agg(F.count("*").alias("n"))


def first_face(box: dict) -> Column:
    """The first face whose plane the row's vertex lies on."""
    return F.coalesce(*(F.when(F.col(axis) == box[key], name) for name, axis, key in FACES))
