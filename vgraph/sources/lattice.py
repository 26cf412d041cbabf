"""A vessel lattice over the order tables: customers are vertices on a grid, orders with both ends in one graph are vessels.

Whole-number arithmetic only, so that any engine builds the same network. Layers of
vertices are grouped into graphs of bounded size; the number of graphs grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vgraph.functions.geometry import measured
from vgraph.schema import POINT

#: Vertices in a row, in a layer, and layers in a graph.
ROW, LAYER, LAYERS = 12, 144, 4
#: Points of an edge at most.
MOST = 5


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    vid = F.col("vid")
    t = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("vid"), F.col("c_nationkey").cast("long").alias("annotation"))
    at = lambda n: (n * 40 + 20).cast("double")
    t = t.select(F.concat(F.lit("G"), F.expr(f"vid div {LAYER * LAYERS}").cast("string")).alias("graph"), "vid", at(vid % ROW).alias("x"), at(F.expr(f"vid div {ROW}") % ROW).alias("y"), at(F.expr(f"vid div {LAYER}")).alias("z"), "annotation")
    return t.withColumn("distance_to_surface", F.col("z") - 20)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order whose two ends are in one graph."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("eid"), F.col("o_custkey").cast("long").alias("src"))
    step = F.when(F.col("eid") % 97 == 0, 0).when(F.col("eid") % 3 == 0, 1).when(F.col("eid") % 3 == 1, ROW).otherwise(LAYER)
    o = o.withColumn("dst", F.col("src") + step).where(f"src = dst or eid % 3 = 2 or (eid % 3 = 0 and src % {ROW} < {ROW - 1}) or (eid % 3 = 1 and (src div {ROW}) % {ROW} < {ROW - 1})")
    o = o.where(f"src div {LAYER * LAYERS} = dst div {LAYER * LAYERS}")
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("dst"))
    o = o.join(known, "dst", "left_semi")
    row = F.expr(f"(src div {ROW}) % {ROW}")
    o = o.withColumn("nkind", F.when(row < 2, 2).when(row >= 10, 3).otherwise(4))
    place = lambda v, i, j: f"(({v} div {i}) % {j}) * 40 + 20"
    axes = {"x": (1, ROW), "y": (ROW, ROW), "z": (LAYER, 1 << 40)}

    def point(i: int) -> str:
        bump = {"z": f" + CASE WHEN {i}L > 0 AND {i}L < n - 1 THEN ((eid + {i}L) % 3 - 1) * 2 ELSE 0 END"}
        parts = (f"CAST({place('src', *s)} + ({place('dst', *s)} - ({place('src', *s)})) * {i}L / (n - 1){bump.get(a, '')} AS DOUBLE) AS {a}" for a, s in axes.items())
        return f"struct({', '.join(parts)})"

    # an edge has MOST points at most: all are named and the first n taken, which is compiled, as a transform is not
    first = lambda xs: f"slice(array({', '.join(xs)}), 1, CAST(n AS INT))"
    o = o.withColumn("n", F.expr("CAST(2 + eid % 4 AS BIGINT)"))
    o = o.withColumn("points", F.expr(first(map(point, range(MOST)))).cast(f"array<{POINT}>"))
    o = o.withColumn("diameters", F.expr(first(f"CAST(IF(nkind = 4, 4, 8) + (eid + {i}L) % 5 AS DOUBLE)" for i in range(MOST))))
    graph = F.concat(F.lit("G"), F.expr(f"src div {LAYER * LAYERS}").cast("string")).alias("graph")
    return measured(o.select(graph, "eid", "src", "dst", "nkind", "points", "diameters").withColumn("diameter", F.array_max("diameters")))


#: The same in DuckDB's SQL: tables v, e (flat) and pts (one row a point).
SQL = f"""
v AS (SELECT 'G' || (c_custkey // {LAYER * LAYERS}) AS graph, c_custkey::BIGINT AS vid, ((c_custkey % 12) * 40 + 20)::DOUBLE AS x, (((c_custkey // 12) % 12) * 40 + 20)::DOUBLE AS y,
  ((c_custkey // 144) * 40 + 20)::DOUBLE AS z, c_nationkey::BIGINT AS annotation, ((c_custkey // 144) * 40)::DOUBLE AS distance_to_surface FROM customer),
e0 AS (SELECT o_orderkey::BIGINT AS eid, o_custkey::BIGINT AS src, o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 12 ELSE 144 END AS dst FROM orders),
e1 AS (SELECT 'G' || (src // {LAYER * LAYERS}) AS graph, eid, src, dst, CASE WHEN (src // 12) % 12 < 2 THEN 2 WHEN (src // 12) % 12 >= 10 THEN 3 ELSE 4 END AS nkind, 2 + eid % 4 AS n FROM e0
  WHERE (src = dst OR eid % 3 = 2 OR (eid % 3 = 0 AND src % 12 < 11) OR (eid % 3 = 1 AND (src // 12) % 12 < 11)) AND src // {LAYER * LAYERS} = dst // {LAYER * LAYERS} AND dst IN (SELECT c_custkey FROM customer)),
pts AS (SELECT g.*, i, ((src % 12) * 40 + 20) + ((dst % 12) * 40 - (src % 12) * 40) * i / (n - 1)::DOUBLE AS x, (((src // 12) % 12) * 40 + 20) + (((dst // 12) % 12) * 40 - ((src // 12) % 12) * 40) * i / (n - 1)::DOUBLE AS y,
  ((src // 144) * 40 + 20) + ((dst // 144) * 40 - (src // 144) * 40) * i / (n - 1)::DOUBLE + CASE WHEN i > 0 AND i < n - 1 THEN ((eid + i) % 3 - 1) * 2 ELSE 0 END AS z, (CASE WHEN nkind = 4 THEN 4 ELSE 8 END + (eid + i) % 5)::DOUBLE AS d
  FROM e1 g, LATERAL (SELECT unnest(range(0, n)) AS i)),
seg AS (SELECT graph, eid, src, dst, nkind, i, x, y, z, d, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, lead(d) OVER w AS d2 FROM pts WINDOW w AS (PARTITION BY eid ORDER BY i)),
ms AS (SELECT *, sqrt((x2 - x) ^ 2 + (y2 - y) ^ 2 + (z2 - z) ^ 2) AS len FROM seg WHERE x2 IS NOT NULL),
e AS (SELECT graph, eid, any_value(src) AS src, any_value(dst) AS dst, any_value(nkind) AS nkind, sum(len) AS length, max(greatest(d, d2)) AS diameter FROM ms GROUP BY graph, eid),
inc AS (SELECT graph, src AS vid, eid, dst AS other, nkind, length, diameter FROM e UNION ALL SELECT graph, dst, eid, src, nkind, length, diameter FROM e)
"""
