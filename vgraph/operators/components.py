"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vgraph.plans.workspace import materialize

#: Edges up to which one task joins them at once; more go through rounds over all tasks.
SMALL = 200_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every vertex that has an edge to another vertex.

    ``component`` is the smallest id reachable, the vertex itself included.
    Rows with a null end and self-loops are ignored. Each round aggregates
    before it joins, so a hub costs one row per task, and ends in a written
    table; the number of rounds grows with the logarithm of the diameter.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    stars = materialize(pairs.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct(), "cc")
    seen = _signature(stars)
    if seen[0] <= SMALL:
        return stars.coalesce(1).mapInArrow(_joined, "id long, component long")
    while True:
        stars = materialize(_round(stars), "cc")
        now = _signature(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("m").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.select(F.col("v").alias("id"), F.col("m").alias("component")).unionByName(roots)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a bounded number of edges: roots hook onto smaller roots until none is left to."""
    parts = [np.stack([b.column(c).to_numpy() for c in ("v", "m")]) for b in batches]
    if parts:
        ids, found = _labels(np.concatenate(parts, 1))
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "component": pa.array(found)})


def joined_graph(pairs: pa.Table) -> pa.Table:
    """(graph, vid, component) of one graph's pairs (graph, v, m), which are few enough for a task."""
    ids, found = _labels(np.stack([pairs[c].to_numpy() for c in ("v", "m")]))
    return pa.table({"graph": pa.array([pairs["graph"][0].as_py()] * len(ids), pa.string()), "vid": ids, "component": found})


def _labels(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def _round(stars: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step; edges run from v to a smaller m."""
    both = stars.union(stars.select("m", "v")).toDF("u", "w")
    low = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("low"))
    large = both.where("w > u").join(low, "u").select(F.col("w").alias("v"), F.col("low").alias("m"))
    least = large.groupBy("v").agg(F.min("m").alias("low"))
    rest = large.join(least, "v").where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
    return rest.union(least).distinct()


def _signature(stars: DataFrame) -> tuple:
    row = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "m"))).first()
    return tuple(row)
