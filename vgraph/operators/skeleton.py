"""From a skeleton's voxels to nodes, links, end points, isolated points and loops.

Neighbours are found within bricks of space; nodes are components of voxels of
degree over two; links are components of link voxels, ordered by distance from an end.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vgraph.operators.components import connected_components
from vgraph.plans.workspace import Rounds, materialize

#: Voxels along a brick's side, and voxels to a bucket of bricks.
BRICK, BUCKET = 64, 200_000


def numbered(voxels: DataFrame) -> DataFrame:
    """(id, x, y, z) of the distinct active voxels, numbered from 0 in the order of x, y, z."""
    v = materialize(voxels.select("x", "y", "z").distinct(), "voxels")
    # numbers by x: a running count over the planes, then a rank within each plane
    planes = v.groupBy("x").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("x").orderBy("y", "z")) - 1
    return materialize(v.withColumn("at", at).join(planes, "x").select((F.col("base") + F.col("at")).cast("long").alias("id"), "x", "y", "z"), "numbered")


def _beside(table: pa.Table) -> pa.Table:
    """(a, b): each voxel of a bucket's bricks, those of their halos left out, and the neighbours that come after it in x, y, z."""
    side = BRICK + 2
    x = {c: table.column(c).to_numpy() for c in ("id", "x", "y", "z", "bx", "by", "bz")}
    local = [x[c] - x[f"b{c}"] * BRICK + 1 for c in "xyz"]
    _, brick = np.unique(np.stack([x["bx"], x["by"], x["bz"]]), axis=1, return_inverse=True)
    place = ((brick.ravel() * side + local[0]) * side + local[1]) * side + local[2]
    order = np.argsort(place)
    place, ids = place[order], x["id"][order]
    core = np.logical_and.reduce([(c >= 1) & (c <= BRICK) for c in local])[order]
    one, two = [], []
    for dx, dy, dz in product((-1, 0, 1), repeat=3):
        if (dx, dy, dz) > (0, 0, 0):
            wanted = place[core] + (dx * side + dy) * side + dz
            at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
            hit = place[at] == wanted
            one.append(ids[core][hit])
            two.append(ids[at[hit]])
    return pa.table({"a": np.concatenate(one), "b": np.concatenate(two)})


def adjacency(voxels: DataFrame) -> DataFrame:
    """(a, b) of neighbouring voxels (id, x, y, z), each pair in both directions.

    Space is cut into bricks; a voxel at a brick's side also goes to the brick beside it, so each brick finds the neighbours of its own
    voxels. A task takes many bricks; what is shuffled is the voxels and these copies.
    """
    bricks = voxels.select("id", "x", "y", "z")
    for a in "xyz":
        bricks = bricks.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - 1) / BRICK), F.floor((F.col(a) + 1) / BRICK))))
    buckets = voxels.count() // BUCKET + 1
    dealt = bricks.withColumn("bucket", F.pmod(F.xxhash64("bx", "by", "bz"), F.lit(buckets)))
    pairs = dealt.groupBy("bucket").applyInArrow(_beside, "a long, b long")
    return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")


def classified(voxels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Voxels with their degree and kind: isopoint, endpoint, link or node."""
    n = pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    d = F.col("degree")
    out = voxels.join(n, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return out.withColumn("kind", F.when(d == 0, "isopoint").when(d == 1, "endpoint").when(d == 2, "link").otherwise("node"))


def to_graph(voxels: DataFrame) -> dict[str, DataFrame]:
    """nodes, links, link_voxels (in order), endpoints and isopoints of a skeleton given by the (x, y, z) of its voxels.

    A node is a component of voxels of degree three or more: its label counts from 1 by smallest voxel, with its centroid and
    voxels. A link is a maximal chain of link voxels, or a direct contact of end points and nodes, with what its two sides meet: nodes
    (``nodes``) or end points (``endpoints``). A component of link voxels that meets neither is a loop. A chain between two
    end points is one link. A link with more than two sides raises an error.
    """
    v = numbered(voxels)
    pairs = materialize(adjacency(v), "pairs")
    kinds = materialize(classified(v, pairs), "kinds")
    of = lambda k, side: kinds.where(F.col("kind") == k).select(F.col("id").alias(side))

    def grouped(kind: str) -> DataFrame:
        inner = pairs.join(of(kind, "a"), "a").join(of(kind, "b"), "b")
        return of(kind, "id").join(connected_components(inner, "a", "b"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    def labels(rows: DataFrame) -> DataFrame:
        """Components numbered from 1, by buckets of a fixed width so that no single sort holds them all."""
        ids = rows.select("component").distinct().withColumn("bucket", F.floor(F.col("component") / 100_000))
        base = ids.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return ids.join(base, "bucket").select("component", (F.col("base") + F.row_number().over(Window.partitionBy("bucket").orderBy("component"))).cast("long").alias("label"))

    node = grouped("node")
    node = materialize(node.join(labels(node), "component").select("id", F.col("label").alias("node")), "node")
    nodes = node.join(v, "id").groupBy("node").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.array_sort(F.collect_list("id")).alias("voxels"))
    chain = grouped("link")
    chain = materialize(chain.join(labels(chain), "component").select("id", F.col("label").alias("link")), "chain")
    ends = of("endpoint", "id")
    # what each chain meets: the nodes and end points next to its voxels
    beside = pairs.join(chain.withColumnRenamed("id", "a"), "a")
    meets = beside.join(node.select(F.col("id").alias("b"), "node"), "b").select("link", F.col("a").alias("voxel"), F.col("node"), F.lit(None).cast("long").alias("endpoint"))
    meets = materialize(meets.unionByName(beside.join(ends.select(F.col("id").alias("b")), "b").select("link", F.col("a").alias("voxel"), F.lit(None).cast("long").alias("node"), F.col("b").alias("endpoint"))).distinct(), "meets")
    ordered = materialize(_ordered(chain, pairs, meets), "ordered")
    sides = meets.groupBy("link").agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.array_sort(F.collect_list("endpoint")).alias("endpoints"))
    if not sides.where(F.size("nodes") + F.size("endpoints") > 2).isEmpty():
        raise AssertionError("a link meets more than two nodes or end points")
    links = ordered.groupBy("link").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda s: s["id"]).alias("voxels"))
    none = F.array().cast("array<bigint>")
    links = links.join(sides, "link", "left").withColumn("nodes", F.coalesce("nodes", none)).withColumn("endpoints", F.coalesce("endpoints", none))
    links = links.withColumn("is_loop", (F.size("nodes") == 0) & (F.size("endpoints") == 0))
    # end points that touch a node or each other without a voxel between
    touch = pairs.join(ends.withColumnRenamed("id", "a"), "a")
    direct = touch.join(node.select(F.col("id").alias("b"), "node"), "b").select(F.col("a").alias("endpoint"), "node")
    contact = touch.join(ends.select(F.col("id").alias("b")), "b").where("a < b").select(F.array("a", "b").alias("endpoints"))
    contacts = direct.select(F.array("node").alias("nodes"), F.array("endpoint").alias("endpoints")).unionByName(contact.select(none.alias("nodes"), "endpoints"))
    contacts = contacts.select(F.lit(None).cast("long").alias("link"), none.alias("voxels"), "nodes", "endpoints", F.lit(False).alias("is_loop"))
    return {"nodes": nodes, "links": links.unionByName(contacts), "link_voxels": ordered, "endpoints": kinds.where("kind = 'endpoint'").select("id", "x", "y", "z"), "isopoints": kinds.where("kind = 'isopoint'").select("id", "x", "y", "z")}


def _ordered(chain: DataFrame, pairs: DataFrame, meets: DataFrame) -> DataFrame:
    """(link, id, at): voxels by their distance from the first one, the smaller of the chain's two ends.

    A loop begins at its smallest voxel and goes on to the smaller of the two beside it. Distances come from list ranking: each
    step from voxel a to b knows the step that it leads to; in each round it learns what that one knows, so
    steps reach twice as far, and both ends of a chain are found at once. Steps that came to an end are written once, the
    others again in each round; there are as many rounds as the longest chain's length has binary digits.
    """
    own = chain.select(F.col("id").alias("a"), "link")
    inner = pairs.join(own, "a").join(chain.select(F.col("id").alias("b")), "b").select("link", "a", "b")
    inner = materialize(inner, "inner")
    # a loop is cut between its smallest voxel and the larger one beside it
    loops = chain.join(meets.select("link").distinct(), "link", "left_anti").groupBy("link").agg(F.min("id").alias("a"))
    cut = inner.join(loops, ["link", "a"]).groupBy("a").agg(F.max("b").alias("b"))
    cut = materialize(cut.unionByName(cut.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cut")
    inner = materialize(inner.join(cut, ["a", "b"], "left_anti").select("a", "b"), "inner")
    ended = Rounds(chain.sparkSession, "ended", "a long, b long, end long, far long")
    # the step after a -> b is b -> c; a voxel has two beside it at most
    after = inner.select(F.col("a").alias("b"), F.col("b").alias("c"))
    steps = inner.join(after, (inner["b"] == after["b"]) & (inner["a"] != after["c"]), "left").select("a", inner["b"], "c", F.lit(1).cast("long").alias("far"))
    steps = materialize(steps, "steps")
    ended.add(steps.where("c is null").select("a", "b", F.col("b").alias("end"), "far"))
    live = materialize(steps.where("c is not null").select("a", "b", F.col("b").alias("a2"), F.col("c").alias("b2"), "far"), "steps")
    while not live.isEmpty():
        other = live.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("a2").alias("a3"), F.col("b2").alias("b3"), F.col("far").alias("more"), F.lit(None).cast("long").alias("end"))
        done = ended.all().select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.lit(None).cast("long").alias("a3"), F.lit(None).cast("long").alias("b3"), F.col("far").alias("more"), "end")
        moved = live.join(other.unionByName(done), ["a2", "b2"]).select("a", "b", F.col("a3").alias("a2"), F.col("b3").alias("b2"), (F.col("far") + F.col("more")).alias("far"), "end")
        moved = materialize(moved, "steps")
        ended.add(moved.where("end is not null").select("a", "b", "end", "far"))
        live = moved.where("end is null").drop("end")
    ends = ended.all().groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"), F.min(F.struct("end", "far")).alias("e"))
    at = F.when(F.col("n") == 2, F.col("e.far")).when(F.col("id") > F.col("e.end"), F.col("e.far")).otherwise(0)
    return chain.join(ends, "id", "left").select("link", "id", at.cast("int").alias("at"))


def link_lengths(ordered: DataFrame, voxels: DataFrame) -> DataFrame:
    """(link, n_voxels, length): the chain's Euclidean length over its ordered voxels."""
    w = Window.partitionBy("link").orderBy("at")
    p = ordered.join(numbered(voxels), "id")
    step = F.sqrt(sum((F.pow(F.col(a) - F.lag(a).over(w), F.lit(2.0)) for a in "xyz"), F.lit(0.0)))
    return p.withColumn("step", step).groupBy("link").agg(F.count("*").alias("n_voxels"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))
