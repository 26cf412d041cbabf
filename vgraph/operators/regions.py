"""Ontology trees: descendants with depth, region selection, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vgraph.plans.workspace import materialize


def descendants(regions: DataFrame, root: int | None = None, name: str | None = None) -> DataFrame:
    """(id, depth) of a region, found by id or name, and all below it in ``regions`` (id, parent_id, name); the root has depth 0."""
    start = regions.where(F.col("id") == root if root is not None else F.col("name") == name).select("id", F.lit(0).alias("depth"))
    every = level = materialize(start, "level")
    while True:
        level = materialize(level.select(F.col("id").alias("parent_id"), (F.col("depth") + 1).alias("depth")).join(regions.select("id", "parent_id"), "parent_id").select("id", "depth").join(every, "id", "left_anti"), "level")
        if level.isEmpty():
            return every
        every = every.unionByName(level)


def select_region(vertices: DataFrame, edges: DataFrame, chosen: DataFrame, levels: int | None = None, without: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The vertices whose annotation is among ``chosen`` (id, depth) down to a level, and the edges with an end in them."""
    keep = chosen if levels is None else chosen.where(F.col("depth") <= levels)
    if without:
        keep = keep.where(~F.col("id").isin(without))
    v = vertices.join(keep.select(F.col("id").alias("annotation")).distinct(), "annotation", "left_semi")
    ends = edges.select("graph", "eid", F.explode(F.array("src", "dst")).alias("vid")).join(v.select("graph", "vid"), ["graph", "vid"], "left_semi")
    return v, edges.join(ends.select("graph", "eid").distinct(), ["graph", "eid"], "left_semi")


def annotation_counts(vertices: DataFrame, chosen: DataFrame) -> DataFrame:
    """Vertices for each of the chosen regions, zero where there are none."""
    n = vertices.groupBy(F.col("annotation").alias("id")).agg(F.count("*").alias("n"))
    return chosen.join(n, "id", "left").na.fill(0, ["n"])


def children(regions: DataFrame) -> DataFrame:
    """(id, n_children) of every region."""
    n = regions.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    return regions.select("id").join(n, "id", "left").na.fill(0)


def subtree_sizes(regions: DataFrame) -> DataFrame:
    """(id, n_below): how many regions lie below each one in a tree (id, parent_id).

    Each region counts for all its ancestors; pairs with ancestors reach twice as far in each round.
    """
    up = materialize(regions.where("parent_id is not null").select("id", F.col("parent_id").alias("above")), "above")
    pairs, step = up, up
    while True:
        far = step.select(F.col("id").alias("above"), F.col("above").alias("next")).join(pairs, "above").select("id", F.col("next").alias("above"))
        far = materialize(far, "above")
        if far.isEmpty():
            break
        pairs = pairs.unionByName(far)
        step = materialize(step.select(F.col("id").alias("above"), F.col("above").alias("next")).join(step, "above").select("id", F.col("next").alias("above")), "above")
    n = pairs.groupBy(F.col("above").alias("id")).agg(F.count("*").alias("n_below"))
    return regions.select("id").join(n, "id", "left").na.fill(0)
