"""Networks from voxel lists: nodes and links given by indices into a volume, radii and labels by index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vgraph.functions.geometry import segments, unraveled, voxel_length


def sparse(pairs: DataFrame) -> DataFrame:
    """(idx, value) without zeros and non-finite values."""
    return pairs.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & (F.col("value") != 0) & (F.abs(F.col("value").cast("double")) < float("inf")))


def nodes(node_cc: DataFrame, radius: DataFrame, mask: tuple, graph: str) -> DataFrame:
    """Vertices from (label, cc: array of 1-based indices): the centroid of the voxels, twice the median radius."""
    v = node_cc.select("label", F.explode("cc").alias("idx")).join(sparse(radius).withColumnRenamed("value", "r"), "idx", "left")
    v = v.select("label", "r", unraveled(F.col("idx"), mask[0], mask[1]).alias("p"))
    return v.groupBy("label").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"), F.avg("p.z").alias("z"), (2 * F.median("r")).alias("diameter"), F.count("*").alias("n_voxels")).select(F.lit(graph).alias("graph"), F.col("label").cast("long").alias("vid"), "x", "y", "z", "diameter", "n_voxels")


def links(link_cc: DataFrame, radius: DataFrame, labels: DataFrame, mask: tuple, graph: str, voxel: float = 1.0) -> DataFrame:
    """Edges from (link, cc, src, dst; 0 is an open end): points in order, length with one voxel, twice the median radius, and
    the most frequent label, the first met on a tie (1 capillary, 2 artery, 3 vein)."""
    p = link_cc.select("link", "src", "dst", F.posexplode("cc").alias("at", "idx"))
    p = p.join(sparse(radius).withColumnRenamed("value", "r"), "idx", "left").join(sparse(labels).withColumnRenamed("value", "l"), "idx", "left")
    p = p.select("link", "src", "dst", "at", "r", F.col("l").cast("int").alias("l"), unraveled(F.col("idx"), mask[0], mask[1]).alias("p"))
    votes = p.where("l is not null").groupBy("link", "l").agg(F.count("*").alias("n"), F.min("at").alias("first")).groupBy("link").agg(F.min_by("l", F.struct(-F.col("n"), F.col("first"))).alias("vote"))
    e = p.groupBy("link", "src", "dst").agg(F.array_sort(F.collect_list(F.struct("at", "p", "r"))).alias("ps"), F.median("r").alias("radius")).join(votes, "link", "left")
    e = e.withColumn("points", F.transform("ps", lambda s: F.struct(s["p"]["x"].cast("double").alias("x"), s["p"]["y"].cast("double").alias("y"), s["p"]["z"].cast("double").alias("z"))))
    nkind = F.when(F.col("vote") == 1, 4).when(F.col("vote").isin(2, 3), F.col("vote"))
    ends = [F.nullif(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("src", "dst")]
    return e.select(F.lit(graph).alias("graph"), F.col("link").cast("long").alias("eid"), *ends, nkind.alias("nkind"), voxel_length(F.col("points"), voxel).alias("length"), (2 * F.col("radius")).alias("diameter"), "points", F.transform("ps", lambda s: 2 * s["r"]).alias("diameters"), segments(F.col("points")).alias("lengths2"))


def closed(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of which both ends are known vertices."""
    e = edges.where("src is not null and dst is not null")
    for side in ("src", "dst"):
        e = e.join(vertices.select("graph", F.col("vid").alias(side)), ["graph", side], "left_semi")
    return e
