"""The registered queries over the lattice network, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vgraph.functions import geometry, stats
from vgraph.operators import clip, flow, morphology, paths, quality, regions, skeleton, topology
from vgraph.plans import analysis
from vgraph.plans.analysis import boundary_tests, network_summary, region_comparison
from vgraph.plans.workspace import materialize, work_dir
from vgraph.schema import label
from vgraph.sources import bundle, lattice, voxel_graph, vtp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: A box of 400 um, small ones of 100 um every 50 um, as in a standard analysis.
BOX = {"xmin": 20.0, "xmax": 420.0, "ymin": 20.0, "ymax": 420.0, "zmin": 20.0, "zmax": 420.0}


def query(sql: str | None = None, ctes: str = "", written: bool = False):
    """Registers a function of (vertices, edges); ``sql`` follows the lattice's tables and ``ctes``.

    ``written`` edges are computed once and read back, for queries that name points or lengths many times.
    """

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            e = lattice.edges(spark, sf_dir)
            return f(lattice.vertices(spark, sf_dir), materialize(e, "lattice") if written else e)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"WITH {lattice.SQL}{',' + ctes if ctes else ''}\n{sql}"
        return f

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


TOUCH = """t AS (SELECT graph, vid, bool_or(nkind = 2) AS a, bool_or(nkind = 3) AS v, bool_or(nkind = 4) AS c FROM inc GROUP BY ALL)"""
TYPES = TOUCH + """, ty AS (SELECT v.graph, v.vid, CASE WHEN t.a THEN 'artery' WHEN t.v THEN 'vein' WHEN t.c THEN 'capillary' ELSE 'unknown' END AS type FROM v LEFT JOIN t USING (graph, vid))"""
REACH = """pairs AS (SELECT graph, src AS a, dst AS b FROM e UNION SELECT graph, dst, src FROM e UNION SELECT graph, vid, vid FROM v),
 reach AS (WITH RECURSIVE r(graph, vid, target) AS (SELECT graph, vid, vid FROM v UNION SELECT p.graph, p.b, r.target FROM r JOIN pairs p ON p.graph = r.graph AND p.a = r.vid WHERE p.b > r.target) SELECT * FROM r)"""
GIANT = REACH + """, lab AS (SELECT graph, vid, min(target) AS component FROM reach GROUP BY ALL), big AS (SELECT graph, component FROM (SELECT graph, component, row_number() OVER (PARTITION BY graph ORDER BY count(*) DESC, component) AS nth FROM lab GROUP BY graph, component) WHERE nth = 1),
 gv AS (SELECT graph, vid FROM lab JOIN big USING (graph, component))"""
#: The artery edges with their components, and the table of these.
TREES = """ap AS (SELECT graph, src AS a, dst AS b FROM e WHERE nkind = 2 UNION SELECT graph, dst, src FROM e WHERE nkind = 2),
 ar AS (WITH RECURSIVE r(graph, vid, target) AS (SELECT graph, a, a FROM ap UNION SELECT p.graph, p.b, r.target FROM r JOIN ap p ON p.graph = r.graph AND p.a = r.vid WHERE p.b > r.target) SELECT * FROM r),
 al AS (SELECT graph, vid, min(target) AS component FROM ar GROUP BY ALL), ae AS (SELECT e.*, component FROM e JOIN al ON al.graph = e.graph AND al.vid = src WHERE nkind = 2),
 an AS (SELECT graph, component, count(*) AS n_nodes, count(*) FILTER (d >= 3) AS n_branch FROM (SELECT graph, component, vid, count(*) AS d FROM (SELECT graph, component, src AS vid FROM ae UNION ALL SELECT graph, component, dst FROM ae) GROUP BY ALL) GROUP BY ALL),
 atab AS (SELECT *, greatest(10.0::DOUBLE, 0.2::DOUBLE * max(n_edges) OVER (PARTITION BY graph)) AS threshold, 100.0 * n_edges / sum(n_edges) OVER (PARTITION BY graph) AS pct_edges FROM (SELECT graph, component, count(*) AS n_edges FROM ae GROUP BY ALL) JOIN an USING (graph, component)),
 am AS (SELECT *, n_edges >= threshold AND n_branch >= 1 AS is_major FROM atab), trees AS (SELECT *, CASE WHEN is_major THEN row_number() OVER (PARTITION BY graph ORDER BY is_major DESC, n_edges DESC, component) END::INT AS major_tree_id FROM am)"""
DEGREE = """deg AS (SELECT v.graph, v.vid, count(eid) AS degree FROM v LEFT JOIN inc USING (graph, vid) GROUP BY ALL)"""


@query("""SELECT graph, nkind::INT AS nkind, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY graph) AS pct, CASE nkind WHEN 2 THEN 'artery' WHEN 3 THEN 'vein' ELSE 'capillary' END AS type FROM e GROUP BY graph, nkind""".replace("100.0 * count(*)", "round(100.0 * count(*)").replace("(PARTITION BY graph) AS", "(PARTITION BY graph), 4) AS"))
def edge_type_stats(v, e):
    return rounded(topology.edge_types(e))


@query("""SELECT graph, nkind::INT AS nkind, count(*) AS n, round(sum(length), 4) AS sum_length, round(avg(length), 4) AS mean_length, round(median(length), 4) AS median_length, round(stddev_samp(length), 4) AS std_length,
 round(100 * sum(length) / sum(sum(length)) OVER (PARTITION BY graph), 4) AS pct_length FROM e GROUP BY graph, nkind""")
def length_by_class(v, e):
    return rounded(morphology.length_by_class(e))


@query("""SELECT graph, nkind::INT AS nkind, count(*) AS n, round(avg(diameter), 4) AS mean_diameter, median(diameter) AS median_diameter, round(quantile_cont(diameter, 0.05), 4) AS p5_diameter, round(quantile_cont(diameter, 0.95), 4) AS p95_diameter,
 round(100 * avg(CASE WHEN nkind = 4 THEN (diameter BETWEEN 4 AND 7)::INT ELSE (diameter BETWEEN 9 AND 12)::INT END), 4) AS pct_in_range FROM e GROUP BY graph, nkind""")
def diameter_by_class(v, e):
    return rounded(morphology.diameter_by_class(e, {2: (9, 12), 3: (9, 12), 4: (4, 7)}))


@query("""SELECT graph, count(*) FILTER (n > 1) AS n_pairs, sum(n - 1)::BIGINT AS n_extra, sum(n)::BIGINT AS n_edges, round(100.0 * sum(n - 1) / sum(n), 4) AS pct_extra FROM
 (SELECT graph, least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM e GROUP BY ALL) GROUP BY graph""")
def duplicated_edges(v, e):
    return rounded(topology.duplicated_edges(e))


@query("""SELECT graph, count(*) FILTER (src = dst) AS n_loops, count(*) AS n_edges, round(100.0 * count(*) FILTER (src = dst) / count(*), 4) AS pct_loops FROM e GROUP BY graph""")
def loop_edges(v, e):
    return rounded(topology.loop_edges(e).drop("loop_ids"))


@query("SELECT graph, vid, degree, CASE WHEN degree >= 4 THEN degree ELSE 0 END AS hdn FROM deg", DEGREE)
def degrees(v, e):
    return topology.degrees(v, e, 4)


@query("SELECT graph, type, degree, count(*) AS n FROM deg JOIN ty USING (graph, vid) GROUP BY ALL", TYPES + "," + DEGREE)
def degree_histogram(v, e):
    return topology.degree_histogram(v, e)


@query("""SELECT graph, nv AS n_vertices, coalesce(ne, 0) AS n_edges, CASE WHEN nv > 1 THEN round(2.0 * coalesce(ne, 0) / (nv * (nv - 1)), 6) END AS density FROM (SELECT graph, count(*) AS nv FROM v GROUP BY 1) LEFT JOIN (SELECT graph, count(*) AS ne FROM e GROUP BY 1) USING (graph)""")
def graph_density(v, e):
    return rounded(topology.density(v, e), 6)


@query("SELECT graph, vid, type FROM ty", TYPES)
def vertex_types(v, e):
    return topology.vertex_types(v, e)


@query("SELECT graph, vid, 'frontier' AS kind FROM t WHERE a AND c UNION ALL SELECT graph, vid, 'venous' FROM t WHERE v", TOUCH)
def frontier_and_venous(v, e):
    return topology.frontier(e).withColumn("kind", F.lit("frontier")).unionByName(topology.venous(e).withColumn("kind", F.lit("venous")))


@query("""SELECT graph, an AS artery_nodes, vn AS vein_nodes, ac AS ac_nodes, vc AS vc_nodes, av AS av_nodes, coalesce(ce, 0) AS capillary_edges, coalesce(aa, 0) AS attached_artery, coalesce(av2, 0) AS attached_vein, coalesce(ba, 0) AS boundary_artery, coalesce(bv, 0) AS boundary_vein, coalesce(na, 0) AS beside_artery, coalesce(nv, 0) AS beside_vein, least(coalesce(na, 0), coalesce(nv, 0)) AS bound FROM
 (SELECT graph, count(*) FILTER (a) AS an, count(*) FILTER (v) AS vn, count(*) FILTER (a AND c) AS ac, count(*) FILTER (v AND c) AS vc, count(*) FILTER (a AND v) AS av FROM t GROUP BY graph) LEFT JOIN
 (SELECT e.graph, count(*) AS ce, count(*) FILTER (s.a OR d.a) AS aa, count(*) FILTER (s.v OR d.v) AS av2, count(*) FILTER (s.a <> d.a) AS ba, count(*) FILTER (s.v <> d.v) AS bv,
  count(DISTINCT CASE WHEN s.a <> d.a THEN CASE WHEN s.a THEN dst ELSE src END END) AS na, count(DISTINCT CASE WHEN s.v <> d.v THEN CASE WHEN s.v THEN dst ELSE src END END) AS nv FROM e JOIN t s ON s.graph = e.graph AND s.vid = src JOIN t d ON d.graph = e.graph AND d.vid = dst WHERE nkind = 4 GROUP BY 1) USING (graph)""", TOUCH)
def interface_counts(v, e):
    return topology.interfaces(e)



@query("""SELECT graph, count(*) AS n_microsegments, round(sum(len), 4) AS sum_length, round(sum(pi() * ((d + d2) / 4) ^ 2 * len), 3) AS volume FROM ms WHERE len > 0 GROUP BY graph""", written=True)
def microsegments(v, e):
    ms = morphology.microsegments(e)
    return ms.groupBy("graph").agg(F.count("*").alias("n_microsegments"), F.round(F.sum("length"), 4).alias("sum_length"), F.round(F.sum(F.lit(3.141592653589793) * F.pow((F.col("r0") + F.col("r1")) / 2, F.lit(2.0)) * F.col("length")), 3).alias("volume"))


@query("""SELECT g.graph, g.i, g.j, g.k, g.type, round(coalesce(sum(pi() * ((d + d2) / 4) ^ 2 * len), 0) / 1e6, 6) AS volume_density, round(coalesce(sum(len), 0) * 1e-3 / 1e-3 - 1e-7, 2) AS length_density
 FROM grid g LEFT JOIN m ON m.graph = g.graph AND mx BETWEEN 20 + 50 * i AND 120 + 50 * i AND my BETWEEN 20 + 50 * j AND 120 + 50 * j AND mz BETWEEN 20 + 50 * k AND 120 + 50 * k AND (g.type = 'total' OR g.type = m.type) GROUP BY ALL""",
 """m AS (SELECT graph, d, d2, len, (x + x2) / 2 AS mx, (y + y2) / 2 AS my, (z + z2) / 2 AS mz, CASE nkind WHEN 2 THEN 'artery' WHEN 3 THEN 'vein' ELSE 'capillary' END AS type FROM ms WHERE len > 0),
 grid AS (SELECT DISTINCT graph, i::INT AS i, j::INT AS j, k::INT AS k, type FROM m m0, range(7) a(i), range(7) b(j), range(7) c(k), (VALUES ('total'), ('artery'), ('vein'), ('capillary')) y(type))""".replace("graph, i::INT", "m0.graph, i::INT").replace("AS k, type FROM", "AS k, y.type FROM"))
def sub_box_densities(v, e):
    # sums of lengths often end in a 5: rounded a little off it, so that the order of the sum doesn't show
    return morphology.densities(morphology.microsegments(e), BOX).withColumns({"volume_density": F.round("volume_density", 6), "length_density": F.round(F.col("length_density") - 1e-7, 2)})


@query("""SELECT graph, slab, round(coalesce(sum(vol) FILTER (nkind = 2), 0) / (400 * 400 * 50.0), 6) AS artery, round(coalesce(sum(vol) FILTER (nkind = 3), 0) / (400 * 400 * 50.0), 6) AS vein, round(coalesce(sum(vol) FILTER (nkind = 4), 0) / (400 * 400 * 50.0), 6) AS capillary, round(sum(vol) / (400 * 400 * 50.0), 6) AS total FROM
 (SELECT graph, nkind, pi() * ((d + d2) / 4) ^ 2 * len AS vol, least(floor(((z + z2) / 2 - 20) / 50), 7)::BIGINT AS slab FROM ms WHERE len > 0 AND (x + x2) / 2 BETWEEN 20 AND 420 AND (y + y2) / 2 BETWEEN 20 AND 420 AND (z + z2) / 2 BETWEEN 20 AND 420) GROUP BY ALL""")
def slab_fractions(v, e):
    return rounded(morphology.slabs(morphology.microsegments(e), BOX, 50.0), 6)


FACE = """fc AS (SELECT v.*, f.face, abs(CASE f.ax WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END - f.plane) AS gap, (f.ax = 'x' OR x BETWEEN 20 AND 420) AND (f.ax = 'y' OR y BETWEEN 20 AND 420) AND (f.ax = 'z' OR z BETWEEN 20 AND 420) AS within
 FROM v, (VALUES ('x_min', 'x', 20), ('x_max', 'x', 420), ('y_min', 'y', 20), ('y_max', 'y', 420), ('z_min', 'z', 20), ('z_max', 'z', 420)) f(face, ax, plane)),
 bc AS (SELECT graph, vid, face FROM fc WHERE gap <= 5 AND within), vd AS (SELECT graph, vid, avg(diameter) AS dm FROM (SELECT DISTINCT graph, vid, eid, diameter FROM inc) GROUP BY ALL)"""


@query("""SELECT graph, face, type, count(*) AS n, count(*) FILTER (degree >= 4) AS n_high, round(avg(dm), 4) AS mean_diameter, round(median(dm), 4) AS median_diameter, round(stddev_samp(dm), 4) AS std_diameter, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY graph, face), 4) AS pct
 FROM bc JOIN ty USING (graph, vid) JOIN deg USING (graph, vid) LEFT JOIN vd USING (graph, vid) GROUP BY graph, face, type""", TYPES + "," + DEGREE + "," + FACE)
def boundary_faces(v, e):
    return rounded(morphology.boundary_stats(morphology.boundary(v, e, morphology.face_vertices(v, BOX, 5.0))))


@query("""SELECT graph, type, count(*) AS n, round(avg(dm), 4) AS mean, round(median(dm), 4) AS median, round(stddev_samp(dm), 4) AS std, sum(count(*)) OVER (PARTITION BY graph)::BIGINT AS total, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY graph), 4) AS pct
 FROM bc JOIN ty USING (graph, vid) LEFT JOIN vd USING (graph, vid) WHERE type <> 'unknown' GROUP BY graph, type""", TYPES + "," + FACE)
def boundary_pooled(v, e):
    return rounded(morphology.boundary_pooled(morphology.boundary(v, e, morphology.face_vertices(v, BOX, 5.0))))


@query("SELECT graph, face, min(gap) AS min_gap, count(*) FILTER (gap <= 5) AS n_near FROM fc GROUP BY ALL", TYPES + "," + FACE)
def near_planes(v, e):
    return morphology.near_planes(v, BOX, 5.0)


@query("""SELECT graph, count(*) AS n, min(distance_to_surface) AS min_depth, round(avg(distance_to_surface), 4) AS mean_depth, median(distance_to_surface) AS median_depth, max(distance_to_surface) AS max_depth,
 count(*) FILTER (distance_to_surface >= 0 AND distance_to_surface < 20) AS n_bin0, round(avg((distance_to_surface >= 0 AND distance_to_surface < 20)::INT), 4) AS share_bin0, count(*) FILTER (distance_to_surface >= 20 AND distance_to_surface < 50) AS n_bin1, round(avg((distance_to_surface >= 20 AND distance_to_surface < 50)::INT), 4) AS share_bin1,
 count(*) FILTER (distance_to_surface >= 50 AND distance_to_surface < 200) AS n_bin2, round(avg((distance_to_surface >= 50 AND distance_to_surface < 200)::INT), 4) AS share_bin2, count(*) FILTER (distance_to_surface >= 200) AS n_bin3, round(avg((distance_to_surface >= 200)::INT), 4) AS share_bin3 FROM v GROUP BY graph""")
def depth_stats(v, e):
    return rounded(morphology.depth_stats(v))


@query("""SELECT graph, n, n_high, round(all_x, 4) AS all_x, round(all_y, 4) AS all_y, round(all_z, 4) AS all_z, round(high_x, 4) AS high_x, round(high_y, 4) AS high_y, round(high_z, 4) AS high_z, round(ma, 4) AS mean_distance_all, round(mh, 4) AS mean_distance_high, round(share, 4) AS max_face_share,
 round(n_high / n, 4) AS share_high, round(sqrt((high_x - all_x) ^ 2 + (high_y - all_y) ^ 2 + (high_z - all_z) ^ 2), 4) AS shift, round(mh / nullif(ma, 0), 4) AS compactness, n_artery, n_vein, n_capillary, min_depth, round(mean_depth, 4) AS mean_depth, max_depth FROM centre JOIN
 (SELECT graph, avg(sqrt((x - all_x) ^ 2 + (y - all_y) ^ 2 + (z - all_z) ^ 2)) AS ma, avg(CASE WHEN high THEN sqrt((x - high_x) ^ 2 + (y - high_y) ^ 2 + (z - high_z) ^ 2) END) AS mh FROM hv JOIN centre USING (graph) GROUP BY graph) USING (graph)
 LEFT JOIN (SELECT graph, max(share) AS share FROM (SELECT graph, face, avg((gap <= 5)::INT) AS share FROM fc JOIN (SELECT vid FROM hv WHERE high) USING (vid) GROUP BY ALL) GROUP BY graph) USING (graph)""", TYPES + "," + DEGREE + "," + FACE + """,
 hv AS (SELECT v.*, degree >= 4 AS high, type FROM v JOIN deg USING (graph, vid) JOIN ty USING (graph, vid)), centre AS (SELECT graph, count(*) AS n, count(*) FILTER (high) AS n_high, avg(x) AS all_x, avg(y) AS all_y, avg(z) AS all_z, avg(x) FILTER (high) AS high_x, avg(y) FILTER (high) AS high_y, avg(z) FILTER (high) AS high_z,
 count(*) FILTER (high AND type = 'artery') AS n_artery, count(*) FILTER (high AND type = 'vein') AS n_vein, count(*) FILTER (high AND type = 'capillary') AS n_capillary, min(distance_to_surface) FILTER (high) AS min_depth, avg(distance_to_surface) FILTER (high) AS mean_depth, max(distance_to_surface) FILTER (high) AS max_depth FROM hv GROUP BY graph)""")
def high_degree_pattern(v, e):
    return rounded(morphology.high_degree(v, e, BOX))


@query("""SELECT graph, vid, min(target) AS component FROM reach GROUP BY ALL""", REACH)
def component_labels(v, e):
    return topology.components(v, e)


@query("SELECT graph, n_vertices, n_edges, sum_length FROM (SELECT graph, count(*) AS n_vertices FROM gv GROUP BY 1) LEFT JOIN (SELECT e.graph, count(*) AS n_edges, round(sum(length), 4) AS sum_length FROM e JOIN gv ON gv.graph = e.graph AND gv.vid = src GROUP BY 1) USING (graph)", GIANT)
def giant_component(v, e):
    gv, ge = topology.giant_component(v, e)
    return gv.groupBy("graph").agg(F.count("*").alias("n_vertices")).join(ge.groupBy("graph").agg(F.count("*").alias("n_edges"), F.round(F.sum("length"), 4).alias("sum_length")), "graph", "left")


@query("SELECT graph, component, n_edges, n_nodes, n_branch, round(threshold, 4) AS threshold, is_major, round(pct_edges, 4) AS pct_edges, major_tree_id FROM trees", TREES)
def major_trees(v, e):
    table, _ = topology.class_components(e, 2)
    return rounded(table)


@query("""SELECT eid, round(length, 6) AS length, round(CASE WHEN straight > 0 THEN length / straight ELSE 1 END, 6) AS tortuosity, round(length * 1.051, 6) AS rescaled, round(w, 6) AS w_cap_prior FROM
 (SELECT e.eid, e.length, sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2 + (b.z - a.z) ^ 2) AS straight, e.length + CASE WHEN e.nkind = 4 THEN 0 ELSE 1e5 END AS w FROM e JOIN pts a ON a.eid = e.eid AND a.i = 0 JOIN pts b ON b.eid = e.eid AND b.i = b.n - 1)""")
def edge_geometry(v, e):
    _, scaled = geometry.rescaled(v, e, 1.051)
    s = scaled.select("eid", F.col("length").alias("rescaled"))
    out = topology.with_penalties(e).withColumn("tortuosity", geometry.tortuosity(F.col("points"))).join(s, "eid")
    return rounded(out.select("eid", "length", "tortuosity", "rescaled", "w_cap_prior"), 6)


@query("""SELECT eid, round(sum(sqrt(((x2 - x) * 1.625) ^ 2 + ((y2 - y) * 1.625) ^ 2 + ((z2 - z) * 2.5) ^ 2)), 6) AS length, round(max(greatest(d, d2)) * 1.625, 6) AS diameter FROM ms GROUP BY eid""")
def in_micrometres(v, e):
    _, out = geometry.to_um(v, e, (1.625, 1.625, 2.5))
    return rounded(out.select("eid", "length", "diameter"), 6)


@query("""SELECT e.eid, CASE WHEN a.i AND b.i THEN 'in' WHEN a.i OR b.i THEN 'across' ELSE 'outside' END AS place FROM e JOIN vi a ON a.vid = src JOIN vi b ON b.vid = dst""", "vi AS (SELECT vid, x BETWEEN 20 AND 420 AND y BETWEEN 20 AND 420 AND z BETWEEN 20 AND 420 AS i FROM v)")
def box_classes(v, e):
    return clip.classify(v, e, BOX).select("eid", "place")


@query("""SELECT graph, count(DISTINCT eid) AS n_edges, round(sum(length), 4) AS sum_length FROM e JOIN vi a ON a.vid = src JOIN vi b ON b.vid = dst WHERE a.i AND b.i GROUP BY graph""", "vi AS (SELECT vid, x BETWEEN 20 AND 420 AND y BETWEEN 20 AND 420 AND z BETWEEN 20 AND 420 AS i FROM v)")
def induced_box(v, e):
    _, out = clip.induced(v, e, BOX)
    return out.groupBy("graph").agg(F.count("*").alias("n_edges"), F.round(F.sum("length"), 4).alias("sum_length"))


@query("""SELECT graph, face, n, n_edges, sum_length FROM (SELECT graph, face, count(*) AS n FROM cross_at GROUP BY ALL) JOIN (SELECT graph, count(*) AS n_edges, round(sum(length), 4) AS sum_length FROM (SELECT graph, length FROM ve WHERE si AND di UNION ALL SELECT graph, length FROM cross_at) GROUP BY graph) USING (graph)""",
 """vi AS (SELECT vid, x BETWEEN 20 AND 405 AND y BETWEEN 20 AND 290 AND z BETWEEN 20 AND 420 AS i FROM v), ve AS (SELECT e.*, a.i AS si, b.i AS di FROM e JOIN vi a ON a.vid = src JOIN vi b ON b.vid = dst),
 pk AS (SELECT p.graph, p.eid, p.x, p.y, p.z, CASE WHEN si THEN i ELSE n - 1 - i END AS k, p.x BETWEEN 20 AND 405 AND p.y BETWEEN 20 AND 290 AND p.z BETWEEN 20 AND 420 AS ok FROM pts p JOIN ve USING (eid) WHERE si <> di),
 fo AS (SELECT eid, min(k) FILTER (NOT ok) AS leaves FROM pk GROUP BY eid), walked AS (SELECT eid, sum(step) AS done FROM (SELECT eid, k, sqrt((lead(x) OVER w - x) ^ 2 + (lead(y) OVER w - y) ^ 2 + (lead(z) OVER w - z) ^ 2) AS step FROM pk WINDOW w AS (PARTITION BY eid ORDER BY k)) JOIN fo USING (eid) WHERE k < leaves - 1 GROUP BY eid),
 ab AS (SELECT a.graph, a.eid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM fo JOIN pk a ON a.eid = fo.eid AND a.k = leaves - 1 JOIN pk b ON b.eid = fo.eid AND b.k = leaves),
 tried AS (SELECT *, (plane - ca) / nullif(cb - ca, 0) AS t FROM (SELECT ab.*, face, nth, plane, axis, low, CASE axis WHEN 'x' THEN ax WHEN 'y' THEN ay ELSE az END AS ca, CASE axis WHEN 'x' THEN bx WHEN 'y' THEN by_ ELSE bz END AS cb
  FROM ab, (VALUES ('x_min', 1, 'x', 20, true), ('x_max', 2, 'x', 405, false), ('y_min', 3, 'y', 20, true), ('y_max', 4, 'y', 290, false), ('z_min', 5, 'z', 20, true), ('z_max', 6, 'z', 420, false)) f(face, nth, axis, plane, low)) WHERE CASE WHEN low THEN cb < plane ELSE cb > plane END),
 placed AS (SELECT *, CASE axis WHEN 'x' THEN plane ELSE ax + t * (bx - ax) END AS px, CASE axis WHEN 'y' THEN plane ELSE ay + t * (by_ - ay) END AS py, CASE axis WHEN 'z' THEN plane ELSE az + t * (bz - az) END AS pz FROM tried),
 cross_at AS (SELECT graph, eid, face, coalesce(done, 0) + sqrt((px - ax) ^ 2 + (py - ay) ^ 2 + (pz - az) ^ 2) AS length FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY nth) AS pick FROM placed WHERE px BETWEEN 20 - 1e-9 AND 405 + 1e-9 AND py BETWEEN 20 - 1e-9 AND 290 + 1e-9 AND pz BETWEEN 20 - 1e-9 AND 420 + 1e-9) LEFT JOIN walked USING (eid) WHERE pick = 1)""")
def clipped(v, e):
    box = BOX | {"xmax": 405.0, "ymax": 290.0}
    cv, ce = clip.cut(v.withColumn("is_border", F.lit(0)).withColumn("border_face", F.lit(None).cast("string")), e, box)
    return rounded(clip.border_report(cv, ce).groupBy("graph", "face").agg(F.sum("n").alias("n")).join(ce.groupBy("graph").agg(F.count("*").alias("n_edges"), F.sum("length").alias("sum_length")), "graph"))


def vessels(e: DataFrame) -> DataFrame:
    """The edges without their points, written once."""
    return materialize(e.select("graph", "eid", "src", "dst", "nkind", "length", "diameter"), "vessels")


def path_sql(name: str, where: str, weight: str) -> str:
    """CTEs: ``name``_p (graph, source, target, dist, path) by walks of every number of edges, and ``name``_s with sums along the paths.

    ``l`` has the least distance to a vein by number of edges, ``t`` the walks that stay within the tolerance of the least.
    """
    return f"""
 {name}_arc AS (SELECT graph, u, v, min(w) AS w FROM (SELECT graph, src AS u, dst AS v, {weight} AS w FROM e WHERE {where} AND src <> dst UNION ALL SELECT graph, dst, src, {weight} FROM e WHERE {where} AND src <> dst) GROUP BY ALL),
 {name}_l AS (WITH RECURSIVE r AS (SELECT graph, vid, 0.0::DOUBLE AS d, 0 AS h FROM t WHERE v UNION ALL SELECT r.graph, a.v, min(d + w), h + 1 FROM r JOIN {name}_arc a ON a.graph = r.graph AND a.u = vid WHERE h < 80 GROUP BY ALL) SELECT graph, vid, min(d) AS least FROM r GROUP BY ALL),
 {name}_t AS (WITH RECURSIVE r AS (SELECT graph, vid, vid AS target, 0.0::DOUBLE AS d, 0 AS h, [vid] AS path FROM t WHERE v
  UNION ALL SELECT graph, vid, target, min(d), h, min_by(path, {{'d': d, 'u': u}}) FROM (SELECT r.graph, a.v AS vid, target, d + w AS d, h + 1 AS h, u, list_prepend(a.v, path) AS path FROM r JOIN {name}_arc a ON a.graph = r.graph AND a.u = r.vid JOIN {name}_l l ON l.graph = r.graph AND l.vid = a.v WHERE d + w <= least + 1e-6) GROUP BY ALL) SELECT * FROM r),
 {name}_p AS (SELECT graph, vid AS source, least AS dist, b.target AS target, b.path AS path FROM (SELECT graph, vid, min_by({{'target': target, 'path': path}}, {{'h': h, 'target': target}}) AS b FROM {name}_t GROUP BY ALL) JOIN {name}_l USING (graph, vid) JOIN t USING (graph, vid) WHERE t.a AND t.c),
 {name}_e AS (SELECT p.graph, p.source, min_by({{'length': length, 'nkind': nkind}}, eid) AS x, i FROM (SELECT graph, source, unnest(path[:-2]) AS u, unnest(path[2:]) AS v, unnest(range(1, len(path))) AS i FROM {name}_p WHERE len(path) > 1) p JOIN e ON e.graph = p.graph AND least(src, dst) = least(u, v) AND greatest(src, dst) = greatest(u, v) GROUP BY ALL),
 {name}_s AS (SELECT p.graph, p.source, any_value(target) AS target, any_value(dist) AS dist, any_value(len(path)) AS n_nodes, any_value(len(path)) - 1 AS n_edges, sum(x.length) AS path_length, CASE WHEN count(i) > 0 THEN coalesce(sum(x.length) FILTER (x.nkind = 2), 0) END AS artery_length, CASE WHEN count(i) > 0 THEN coalesce(sum(x.length) FILTER (x.nkind = 3), 0) END AS vein_length,
  CASE WHEN count(i) > 0 THEN coalesce(sum(x.length) FILTER (x.nkind = 4), 0) END AS capillary_length, count(i) FILTER (x.nkind = 2) AS artery_edges, coalesce(min_by(x.nkind, i) = 2, false) AS starts_with_artery FROM {name}_p p LEFT JOIN {name}_e USING (graph, source) GROUP BY p.graph, p.source)"""


PENALISED = "length + CASE WHEN nkind = 4 THEN 0 ELSE 1e5 END"


@query("SELECT graph, source, target, round(dist, 4) AS dist, n_nodes::INT AS n_nodes, n_edges::INT AS n_edges, round(path_length, 4) AS path_length, round(artery_length, 4) AS artery_length, round(vein_length, 4) AS vein_length, round(capillary_length, 4) AS capillary_length, artery_edges, starts_with_artery, artery_edges > 0 AS contains_artery FROM s_s", TOUCH + "," + path_sql("s", "nkind <> 2", "length"))
def nearest_vein_paths(v, e):
    e = vessels(e)
    return rounded(paths.path_summary(paths.frontier_paths(e), e).drop("kinds"), 4)


@query("""SELECT graph, count(*) AS n, count(*) FILTER (x.target <> y.target) AS n_target_changed, round(100 * avg((x.target <> y.target)::INT), 4) AS pct_target_changed, count(*) FILTER (y.dist - x.dist <> 0) AS n_nonzero, count(*) FILTER (y.dist - x.dist > 0) AS n_longer, count(*) FILTER (y.dist - x.dist < 0) AS n_shorter,
 round(median(y.dist - x.dist), 4) AS median_delta, round(avg(y.dist - x.dist), 4) AS mean_delta, count(*) FILTER (y.artery_edges > 0) AS n_uses_artery FROM s_s x FULL JOIN w_s y USING (graph, source) GROUP BY graph""", TOUCH + "," + path_sql("s", "nkind <> 2", "length") + "," + path_sql("w", "true", PENALISED))
def restricted_weighted(v, e):
    e = vessels(e)
    return rounded(paths.comparison_summary(paths.compare_restricted_weighted(e), "weighted"), 4)


#: Hops between artery and vein vertices by walks of every number of edges, over the edges of ``ge``.
HOPS = """gt AS (SELECT graph, vid, bool_or(nkind = 2) AS a, bool_or(nkind = 3) AS v FROM (SELECT graph, src AS vid, nkind FROM ge UNION ALL SELECT graph, dst, nkind FROM ge) GROUP BY ALL), ga AS (SELECT graph, src AS u, dst AS w FROM ge WHERE src <> dst UNION SELECT graph, dst, src FROM ge WHERE src <> dst),
 hops AS (SELECT graph, source, vid, min(h) AS h FROM (WITH RECURSIVE r AS (SELECT graph, vid AS source, vid, 0 AS h FROM gt WHERE a UNION ALL SELECT DISTINCT r.graph, r.source, w, h + 1 FROM r JOIN ga ON ga.graph = r.graph AND u = vid WHERE h < 45) SELECT * FROM r) GROUP BY ALL)"""


@query("SELECT graph, source, vid AS target, h::INT AS hops FROM hops JOIN gt USING (graph, vid) WHERE v AND NOT a AND h > 0", "ge AS (SELECT * FROM e)," + HOPS)
def artery_vein_hops(v, e):
    """How many edges every artery vertex is away from every vein vertex."""
    e = vessels(e)
    sets = topology.av_sets(v, e)
    return paths.hop_distances(e, sets.where("type = 'artery'"), sets.where("type = 'vein'"))


@query("SELECT graph, source, vid AS target, array_to_string(path, '-') AS path FROM walks JOIN gt USING (graph, vid) WHERE v AND NOT a AND len(path) > 1",
 "ge AS (SELECT e.* FROM e JOIN v x ON x.vid = src JOIN v y ON y.vid = dst WHERE x.x BETWEEN 20 AND 480 AND y.x BETWEEN 20 AND 480 AND x.y BETWEEN 20 AND 480 AND y.y BETWEEN 20 AND 480 AND x.z % 160 BETWEEN 20 AND 60 AND y.z % 160 BETWEEN 20 AND 60)," + HOPS + """,
 walks AS (WITH RECURSIVE r AS (SELECT graph, vid AS source, vid, [vid] AS path FROM gt WHERE a UNION ALL SELECT r.graph, r.source, w, min(list_append(path, w)) FROM r JOIN ga ON ga.graph = r.graph AND u = r.vid JOIN hops ON hops.graph = r.graph AND hops.source = r.source AND hops.vid = w AND h = len(path) GROUP BY ALL) SELECT * FROM r)""".replace("min(list_append(path, w)) FROM", "min(list_append(path, w)) AS path FROM"))
def artery_vein_box_paths(v, e):
    """The paths of fewest edges between all artery and vein vertices of the two first layers of each graph."""
    flat = v.withColumn("z", F.col("z") % 160)
    return paths.box_paths(flat, e, {"xmin": 20.0, "xmax": 480.0, "ymin": 20.0, "ymax": 480.0, "zmin": 20.0, "zmax": 60.0}).withColumn("path", F.array_join("path", "-"))


@query()
def min_cuts(v, e):
    cuts = flow.min_cut(e)
    return rounded(topology.saturation(topology.interfaces(e), cuts).join(cuts.drop("cut_edges", "paths", "n_disjoint"), "graph", "left"), 6)


@query("""SELECT a.graph, a.type AS type1, b.type AS type2, a.n AS n1, b.n AS n2, round((a.m - b.m) / sqrt(a.s / a.n + b.s / b.n), 4) AS t, round((a.s / a.n + b.s / b.n) ^ 2 / ((a.s / a.n) ^ 2 / (a.n - 1) + (b.s / b.n) ^ 2 / (b.n - 1)), 3) AS df
 FROM gs a JOIN gs b ON a.graph = b.graph AND a.nkind < b.nkind""", "gs AS (SELECT graph, nkind, CASE nkind WHEN 2 THEN 'artery' WHEN 3 THEN 'vein' ELSE 'capillary' END AS type, count(*) AS n, avg(length) AS m, var_samp(length) AS s FROM e GROUP BY ALL)")
def welch_tests(v, e):
    out = stats.welch(e.withColumn("type", label(F.col("nkind"))), "length", "type", ["artery", "vein", "capillary"], ["graph"], p=False, medians=False)
    return out.select("graph", "type1", "type2", "n1", "n2", F.round("t", 4).alias("t"), F.round("df", 3).alias("df"))


@query("""SELECT graph, n1, n2, round(d, 6) AS d FROM (SELECT graph, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2, max(abs(c1 / n1 - c2 / n2)) AS d FROM (SELECT graph, sum(a) OVER w AS c1, sum(b) OVER w AS c2, sum(a) OVER (PARTITION BY graph) AS n1, sum(b) OVER (PARTITION BY graph) AS n2
 FROM (SELECT graph, diameter, count(*) FILTER (nkind = 2) AS a, count(*) FILTER (nkind = 3) AS b FROM e WHERE nkind IN (2, 3) GROUP BY ALL) WINDOW w AS (PARTITION BY graph ORDER BY diameter)) GROUP BY graph)""")
def ks_tests(v, e):
    return stats.ks(e.withColumn("type", label(F.col("nkind"))), "diameter", "type", "artery", "vein", ["graph"]).select("graph", "n1", "n2", F.round("d", 6).alias("d"))


@query("""SELECT graph, nkind::INT AS nkind, count(*) AS n, round(avg(delta), 5) AS mean_delta, round(median(delta), 5) AS median_delta, round(avg(delta) / sqrt(var_samp(delta) / count(*)), 3) AS t, (count(*) - 1)::DOUBLE AS df FROM
 (SELECT e.graph, e.nkind, e.length - sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2 + (b.z - a.z) ^ 2) AS delta FROM e JOIN v a ON a.vid = src JOIN v b ON b.vid = dst) GROUP BY ALL""")
def paired_tests(v, e):
    """Lengths against straight distances."""
    p = F.col("points")
    out = stats.paired_t(e.withColumn("delta", F.col("length") - geometry.distance(p[0], F.element_at(p, -1))), "delta", ["graph", "nkind"], p=False)
    return out.withColumns({"mean_delta": F.round("mean_delta", 5), "median_delta": F.round("median_delta", 5), "t": F.round("t", 3)})


@query("""SELECT nkind::INT AS nkind, diameter, round(sum(count(*)) OVER (PARTITION BY nkind ORDER BY diameter) / sum(count(*)) OVER (PARTITION BY nkind), 6) AS share FROM e GROUP BY nkind, diameter""")
def diameter_ecdf(v, e):
    return rounded(stats.ecdf(e, "diameter", ["nkind"]), 6)


@query("""SELECT nkind::INT AS nkind, bin, n, round(n / (sum(n) OVER (PARTITION BY nkind) * 2.0), 6) AS density FROM (SELECT nkind, least(floor((diameter - 4) / 2.0), 5)::BIGINT AS bin, count(*) AS n FROM e WHERE diameter BETWEEN 4 AND 16 GROUP BY ALL)""")
def diameter_histogram(v, e):
    return rounded(stats.histogram(e, "diameter", ["nkind"], 4.0, 16.0, 6), 6)


@query("""SELECT graph, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM (SELECT graph, x, y, z FROM v UNION ALL SELECT graph, x, y, z FROM pts) GROUP BY graph""")
def network_bounds(v, e):
    return rounded(morphology.bounds(v, e), 9)


@query("""SELECT graph, ends, n, n_ok, n_unknown, max_gap FROM (SELECT graph, ends, count(*) AS n FROM (SELECT e.graph, CASE WHEN fa AND lb THEN 'OK_DIRECT' WHEN fb AND la THEN 'OK_SWAP' WHEN fa OR lb OR fb OR la THEN 'BAD_AMBIG' ELSE 'BAD_BOTH' END AS ends FROM e JOIN
 (SELECT f.eid, abs(f.x - a.x) + abs(f.y - a.y) + abs(f.z - a.z) < 1e-6 AS fa, abs(f.x - b.x) + abs(f.y - b.y) + abs(f.z - b.z) < 1e-6 AS fb, abs(l.x - a.x) + abs(l.y - a.y) + abs(l.z - a.z) < 1e-6 AS la, abs(l.x - b.x) + abs(l.y - b.y) + abs(l.z - b.z) < 1e-6 AS lb
 FROM pts f JOIN pts l ON l.eid = f.eid AND l.i = l.n - 1 JOIN v a ON a.vid = f.src JOIN v b ON b.vid = f.dst WHERE f.i = 0) USING (eid)) GROUP BY ALL) JOIN
 (SELECT graph, count(*) FILTER (abs(diameter - top) <= 1e-6 + 1e-3 * top) AS n_ok, 0::BIGINT AS n_unknown, max(abs(diameter - top)) AS max_gap FROM e JOIN (SELECT eid, max(d) AS top FROM pts GROUP BY 1) USING (eid) GROUP BY graph) USING (graph)""")
def data_quality(v, e):
    ends = quality.end_points(v, e).groupBy("graph", "ends").agg(F.count("*").alias("n"))
    return ends.join(quality.radius_consistency(e).select("graph", "n_ok", "n_unknown", "max_gap"), "graph")


@query("SELECT graph, count(*) AS n_lines, sum(n)::BIGINT AS n_points, round(sum(length), 3) AS sum_length FROM e JOIN (SELECT eid, count(*) AS n FROM pts GROUP BY 1) USING (eid) WHERE src <> dst GROUP BY graph")
def vtp_lines(v, e):
    return vtp.lines(v, e).groupBy("graph").agg(F.count("*").alias("n_lines"), F.sum(F.size("points")).alias("n_points"), F.round(F.sum("length"), 3).alias("sum_length"))


@query(written=True)
def region_summary(v, e):
    return rounded(network_summary(v, e, BOX), 4)


@query()
def compared_graphs(v, e):
    """Graphs of even numbers against those of odd ones."""
    group = F.when(F.substring("graph", 2, 20).cast("long") % 2 == 0, "even").otherwise("odd")
    return rounded(region_comparison(v, e, group, "even", "odd"), 4)


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent_id, name): a root, regions of the world, nations."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select((F.col("r_regionkey").cast("long") + 1000).alias("id"), F.lit(9999).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey").cast("long") + 1000).alias("parent_id"), F.col("n_name").alias("name"))
    root = r.select("parent_id").distinct().select(F.col("parent_id").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("root").alias("name"))
    return root.unionByName(r).unionByName(n)


def region_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of each nation below the region of key 1."""
    chosen = regions.descendants(ontology(spark, sf_dir), 1001)
    v = regions.select_region(lattice.vertices(spark, sf_dir), lattice.edges(spark, sf_dir), chosen)[0]
    return regions.annotation_counts(v, chosen)


QUERIES["region_vertices"] = region_vertices
ORACLES["region_vertices"] = "SELECT id, depth, count(c_custkey) AS n FROM (SELECT 1001::BIGINT AS id, 0 AS depth UNION ALL SELECT n_nationkey, 1 FROM nation WHERE n_regionkey = 1) LEFT JOIN customer ON c_nationkey = id GROUP BY ALL"


def skeleton_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, links, loops, end points and isolated points of the voxels that lattice points round to, every 4 um."""
    p = lattice.edges(spark, sf_dir).select(F.explode("points").alias("p"))
    parts = skeleton.to_graph(p.select(*((F.round(F.col(f"p.{a}") / 4)).cast("long").alias(a) for a in "xyz")))
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count("nodes", parts["nodes"]).unionByName(count("links", parts["links"].where("not is_loop"))).unionByName(count("loops", parts["links"].where("is_loop"))).unionByName(count("endpoints", parts["endpoints"])).unionByName(count("isopoints", parts["isopoints"]))


QUERIES["skeleton_graph"] = skeleton_graph


@query("SELECT graph, type, count(*) AS n FROM ty GROUP BY ALL", TYPES)
def type_totals(v, e):
    return topology.vertex_types(v, e).groupBy("graph", "type").agg(F.count("*").alias("n"))


@query("SELECT CASE nkind WHEN 2 THEN 'artery' WHEN 3 THEN 'vein' ELSE 'capillary' END AS type, count(*) AS n, round(quantile_cont(length, 0.05), 6) AS p5, round(median(length), 6) AS median, round(quantile_cont(length, 0.95), 6) AS p95 FROM e GROUP BY 1")
def length_percentiles(v, e):
    return rounded(morphology.summary(e.withColumn("type", label(F.col("nkind"))), ["type"], "length"), 6)


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder among the session's work tables."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT row_number() OVER (ORDER BY eid) - 1 AS eid, src, dst, nkind::INT AS nkind, n AS n_points, round(length, 6) AS length, diameter, round(CASE WHEN straight > 0 THEN length / straight ELSE 1 END, 6) AS tortuosity FROM e JOIN (SELECT eid, count(*) AS n FROM pts GROUP BY 1) USING (eid) JOIN
 (SELECT a.eid, sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2 + (b.z - a.z) ^ 2) AS straight FROM pts a JOIN pts b ON b.eid = a.eid AND b.i = b.n - 1 WHERE a.i = 0) USING (eid)""")
def csv_bundle(v, e):
    """The edges of the lattice written as a bundle of CSV files and read back."""
    folder = fresh(v.sparkSession, "bundle")
    bundle.save(v.withColumn("radius", F.lit(1.0)), e, folder)
    out = bundle.load(v.sparkSession, folder, "all")[1]
    return rounded(out.select("eid", "src", "dst", "nkind", F.size("points").cast("long").alias("n_points"), "length", "diameter", "tortuosity"), 6)


@query("SELECT vid, x, y, z, 4.0::DOUBLE AS diameter, annotation, distance_to_surface FROM v")
def csv_bundle_vertices(v, e):
    folder = fresh(v.sparkSession, "bundle")
    bundle.save(v.withColumn("radius", F.lit(2.0)), e, folder)
    return bundle.load(v.sparkSession, folder, "all")[0].drop("graph")


@query("SELECT graph, nv AS n_vertices, ne AS n_edges, round(sum_length, 4) AS sum_length, round(mean_diameter, 4) AS mean_diameter, 0::BIGINT AS no_class, np AS n_points FROM (SELECT graph, count(*) AS nv FROM v GROUP BY 1) LEFT JOIN (SELECT graph, count(*) AS ne, sum(length) AS sum_length, avg(diameter) AS mean_diameter FROM e GROUP BY 1) USING (graph) LEFT JOIN (SELECT graph, count(*) AS np FROM pts GROUP BY 1) USING (graph)")
def saved_network(v, e):
    """Sizes of the network written as Parquet by graph and read back."""
    folder = fresh(v.sparkSession, "network")
    bundle.save_network(v, e, folder)
    return rounded(quality.overview(*bundle.load_network(v.sparkSession, folder)))


@query("SELECT graph, count(*) AS n_vertices, any_value(ne) AS n_edges, 'x' AS space, 'graph,vid,x,y,z,annotation,distance_to_surface' AS vertex_columns FROM v LEFT JOIN (SELECT graph, count(*) AS ne FROM e GROUP BY 1) USING (graph) GROUP BY graph")
def network_metadata(v, e):
    folder = fresh(v.sparkSession, "network")
    bundle.save_network(v, e, folder, {"space": "x"})
    return v.sparkSession.read.parquet(f"{folder}/graph_meta").drop("edge_columns")


@query("SELECT graph, CASE nkind WHEN 2 THEN 'artery' WHEN 3 THEN 'vein' ELSE 'capillary' END AS type, count(*) AS n, 'all' AS region FROM e GROUP BY ALL")
def result_tables(v, e):
    """A table of results written as CSV and read back beside its region."""
    folder = fresh(v.sparkSession, "results")
    bundle.save_table(topology.edge_types(e).select("graph", "type", "n"), f"{folder}/all_types")
    return bundle.load_results(v.sparkSession, {"all": folder}, "types").withColumn("n", F.col("n").cast("long"))


#: Rows and columns of the volume in which lattice points are voxels; their radii and labels follow from their indices.
SIDE = 480
VOXELS = f"""vx AS (SELECT eid, src, dst, i, floor(x)::BIGINT AS x, floor(y)::BIGINT AS y, floor(z)::BIGINT AS z FROM pts), vi AS (SELECT *, y + {SIDE} * x + {SIDE * SIDE} * z + 1 AS idx FROM vx),
 votes AS (SELECT eid, l FROM (SELECT eid, l, row_number() OVER (PARTITION BY eid ORDER BY n DESC, first) AS nth FROM (SELECT eid, 1 + idx % 3 AS l, count(*) AS n, min(i) AS first FROM vi GROUP BY ALL)) WHERE nth = 1),
 chain AS (SELECT eid, sum(coalesce(sqrt((nx - x) ^ 2 + (ny - y) ^ 2 + (nz - z) ^ 2), 0)) AS length FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM vi WINDOW w AS (PARTITION BY eid ORDER BY i)) GROUP BY eid)"""


def index(x, y, z):
    return (y + SIDE * x + SIDE * SIDE * z + 1).cast("long")


@query("SELECT vid, x + 0.5 AS x, y, z, 2 * median(r)::DOUBLE AS diameter, count(*) AS n_voxels FROM (SELECT vid, x, y, z, 1 + (y + 480 * (x + k) + 480 * 480 * z + 1)::BIGINT % 5 AS r FROM v, (VALUES (0), (1)) t(k)) GROUP BY ALL")
def voxel_nodes(v, e):
    """Vertices from labelled voxels, two for each of the lattice's."""
    cc = v.select(F.col("vid").alias("label"), F.array(index(F.col("x"), F.col("y"), F.col("z")), index(F.col("x") + 1, F.col("y"), F.col("z"))).alias("cc"))
    radius = cc.select(F.explode("cc").alias("idx")).distinct().withColumn("value", (1 + F.col("idx") % 5).cast("double"))
    return voxel_graph.nodes(cc, radius, (SIDE, SIDE), "all").drop("graph")


@query("SELECT eid, src, dst, CASE WHEN l = 1 THEN 4 ELSE l END::INT AS nkind, round(length + 1, 6) AS length, diameter, n AS n_points FROM (SELECT eid, any_value(src) AS src, any_value(dst) AS dst, 2 * median(1 + idx % 5)::DOUBLE AS diameter, count(*) AS n FROM vi GROUP BY eid) JOIN votes USING (eid) JOIN chain USING (eid) WHERE eid % 7 <> 0 AND src <> 0 AND dst <> 0", VOXELS, written=True)
def voxel_links(v, e):
    """Edges from the voxels of the lattice's; an end of every seventh is open, as is one at 0, and these go."""
    cc = e.select(F.col("eid").alias("link"), "src", F.when(F.col("eid") % 7 == 0, 0).otherwise(F.col("dst")).alias("dst"), F.transform("points", lambda p: index(F.floor(p["x"]), F.floor(p["y"]), F.floor(p["z"]))).alias("cc"))
    every = cc.select(F.explode("cc").alias("idx")).distinct()
    value = lambda n: every.withColumn("value", (1 + F.col("idx") % n).cast("double"))
    out = voxel_graph.closed(v.withColumn("graph", F.lit("all")), voxel_graph.links(cc, value(5), value(3), (SIDE, SIDE), "all"))
    return rounded(out.select("eid", "src", "dst", "nkind", "length", "diameter", F.size("points").cast("long").alias("n_points")), 6)


@query("SELECT count(*) FILTER (eid % 7 <> 0) AS n_closed, count(*) FILTER (eid % 7 = 0) AS n_open FROM e")
def open_links(v, e):
    return quality.open_links(e.select("src", F.when(F.col("eid") % 7 != 0, F.col("dst")).alias("dst")))


@query("""SELECT f.graph, f.face, count(b.vid) FILTER (type = 'artery') AS artery, count(b.vid) FILTER (type = 'vein') AS vein, count(b.vid) FILTER (type = 'capillary') AS capillary, count(b.vid) FILTER (type = 'unknown') AS "unknown"
 FROM (SELECT DISTINCT bc.graph, fc.face FROM bc, fc) f LEFT JOIN (SELECT bc.*, type FROM bc JOIN ty USING (graph, vid)) b ON b.graph = f.graph AND b.face = f.face GROUP BY ALL""", TYPES + "," + FACE)
def boundary_table(v, e):
    return morphology.boundary_table(morphology.boundary(v, e, morphology.face_vertices(v, BOX, 5.0)))


@query("""SELECT metric, printf('%.3f', artery) AS artery, printf('%.3f', vein) AS vein, printf('%.3f', capillary) AS capillary FROM (SELECT 'n' AS metric, count(*) FILTER (nkind = 2)::DOUBLE AS artery, count(*) FILTER (nkind = 3)::DOUBLE AS vein, count(*) FILTER (nkind = 4)::DOUBLE AS capillary FROM e
 UNION ALL SELECT 'max_diameter', max(diameter) FILTER (nkind = 2), max(diameter) FILTER (nkind = 3), max(diameter) FILTER (nkind = 4) FROM e)""")
def metric_table(v, e):
    """Metrics as rows and groups, here vessel classes, as columns."""
    rows = e.groupBy(label(F.col("nkind")).alias("graph")).agg(F.count("*").alias("n"), F.max("diameter").alias("max_diameter"))
    return paths.summary_table(rows, ["artery", "vein", "capillary"])


RANGES = """n AS (SELECT eid, count(*) AS n, row_number() OVER (ORDER BY eid) - 1 AS nth FROM pts GROUP BY eid), rg AS (SELECT nth AS eid, sum(n) OVER (ORDER BY nth) - n AS s, sum(n) OVER (ORDER BY nth) AS e2 FROM n), bad AS (SELECT eid, s + CASE WHEN eid % 10 = 3 THEN 1 ELSE 0 END AS start, e2 AS "end" FROM rg)"""


@query('SELECT eid, start::BIGINT AS start, "end"::BIGINT AS "end", expected::BIGINT AS expected FROM (SELECT *, lag("end") OVER (ORDER BY eid) AS expected FROM bad) WHERE expected <> start', RANGES)
def range_breaks(v, e):
    """Ranges of points that don't adjoin, in a bundle with every tenth one moved."""
    r = bundle.ranges(e)
    return quality.ranges_adjoin(r.select("eid", (F.col("start") + (F.col("eid") % 10 == 3).cast("int")).alias("start"), "end"))


@query("SELECT graph, count(*) AS n, max(greatest(abs(first - 4), abs(last - 4))) AS max_gap, count(*) FILTER (greatest(abs(first - 4), abs(last - 4)) > 1e-6) AS n_off FROM (SELECT a.graph, a.d AS first, b.d AS last FROM pts a JOIN pts b ON b.eid = a.eid AND b.i = b.n - 1 WHERE a.i = 0) GROUP BY graph")
def end_diameters(v, e):
    return quality.end_diameters(v.withColumn("diameter", F.lit(4.0)), e).drop("examples")


@query("""SELECT graph, count(*) AS n, count(*) FILTER (eid % 11 = 0) AS bad_length, count(*) FILTER ((eid % 17 = 0 AND len > 0) OR eid % 19 = 0) AS bad_sum, count(*) FILTER (eid % 17 = 0) AS bad_segments, count(*) FILTER (eid % 13 = 0) AS bad_diameter, count(*) FILTER (eid % 19 = 0) AS bad_points FROM ms WHERE i = 0 GROUP BY graph""")
def rescaling_check(v, e):
    """A rescaled network in which some edges break an invariant: a length, a segment, a diameter or a first point is wrong."""
    after = geometry.rescaled(v, e, 1.051)[1]
    some = lambda n: F.col("eid") % n == 0
    moved = F.transform("points", lambda p, i: F.struct(F.when(i == 0, p["x"] + 5).otherwise(p["x"]).alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    after = after.withColumn("length", F.when(some(11), F.col("length") + 1).otherwise(F.col("length"))).withColumn("diameter", F.when(some(13), 2 * F.col("diameter")).otherwise(F.col("diameter")))
    after = after.withColumn("lengths2", F.when(some(17), F.slice("lengths2", F.lit(2), F.greatest(F.size("lengths2") - 1, F.lit(0)))).otherwise(F.col("lengths2"))).withColumn("points", F.when(some(19), moved).otherwise(F.col("points")))
    return quality.rescaling(e, after, 1.051)


@query("SELECT graph, max(abs(z - 25 * x)) AS max_gap, median(abs(z - 25 * x)) AS median_gap FROM v GROUP BY graph")
def diameter_scale(v, e):
    return quality.diameter_scale(v, "x", "z")


@query("SELECT sum(1)::BIGINT AS n_lines, sum(n)::BIGINT AS n_points FROM e JOIN (SELECT eid, count(*) AS n FROM pts GROUP BY 1) USING (eid) WHERE src <> dst")
def vtp_documents(v, e):
    """Lines and points that the written VTP documents declare."""
    folder = fresh(v.sparkSession, "vtp")
    vtp.write(vtp.lines(v, e), folder)
    text = v.sparkSession.read.text(folder)
    number = lambda name: F.sum(F.regexp_extract("value", f'<Piece .*{name}="(\\d+)"', 1).try_cast("long"))
    return text.agg(number("NumberOfLines").alias("n_lines"), number("NumberOfPoints").alias("n_points"))


#: Every edge that is drawn, numbered in order by graph, and its points; the pressure is that of the vertices' heights.
DRAWN = """dr AS (SELECT graph, eid, src, dst, nkind, length, diameter, row_number() OVER (PARTITION BY graph ORDER BY eid) - 1 AS edge FROM e WHERE src <> dst),
 dv AS (SELECT graph, vid, row_number() OVER (PARTITION BY graph ORDER BY vid) - 1 AS nth FROM (SELECT DISTINCT graph, unnest([src, dst]) AS vid FROM dr))"""


def with_pressure(v: DataFrame) -> DataFrame:
    return v.withColumn("pressure", F.col("z") / 7).withColumn("pBC", F.when(F.col("vid") % 5 == 0, F.col("vid")))


@query("""SELECT round((edge + i * 0.1)::DOUBLE, 6) AS "index", round(diameter / 2, 6) AS radius, diameter AS vessel_diameter, round(length, 6) AS vessel_length, nkind::DOUBLE AS vessel_nkind, round(len, 6) AS lengths2, (d + d2) / 2 AS diameters, round(x, 6) AS x1, round(y, 6) AS y1, round(z, 6) AS z1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(z2, 6) AS z2, 2::BIGINT AS n_points
 FROM dr JOIN (SELECT eid, i, x, y, z, x2, y2, z2, d, d2, len FROM ms) USING (eid)""", DRAWN)
def vtp_cells(v, e):
    """The cells of the tortuous network as written to VTP documents and read back, with their values and ends."""
    folder = fresh(v.sparkSession, "vtp")
    vtp.write(vtp.network_lines(v, e), folder)
    return rounded(vtp.read(v.sparkSession, folder).drop("document", "piece", "nth"), 6)


@query("""SELECT "index", round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(pressure, 6) AS pressure, "pBC" FROM (SELECT graph, dv.nth::DOUBLE AS "index", x, y, z, z / 7 AS pressure, CASE WHEN vid % 5 = 0 THEN vid ELSE -1000 END::DOUBLE AS "pBC" FROM dv JOIN v USING (graph, vid)
 UNION ALL SELECT dr.graph, round((edge + i * 0.1)::DOUBLE, 6), p.x, p.y, p.z, a.z / 7 + i * ((b.z / 7 - a.z / 7) / (n - 1)), -1000 FROM dr JOIN (SELECT eid, i, n, x, y, z FROM pts WHERE i > 0 AND i < n - 1) p USING (eid) JOIN v a ON a.vid = dr.src JOIN v b ON b.vid = dr.dst)""", DRAWN)
def vtp_points(v, e):
    """The points of the tortuous network as written and read back; a vertex stands in the document once for each of its edges and is given once."""
    folder = fresh(v.sparkSession, "vtp")
    vtp.write(vtp.network_lines(with_pressure(v), e), folder)
    return rounded(vtp.read(v.sparkSession, folder, "points").drop("document", "piece", "nth"), 6).distinct()


@query("SELECT diameter, round(length, 6) AS length, nkind::DOUBLE AS nkind, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2, 2::BIGINT AS n_points FROM dr JOIN v a ON a.vid = src JOIN v b ON b.vid = dst", DRAWN)
def vtp_straight(v, e):
    """The cells of the straight network as written and read back."""
    folder = fresh(v.sparkSession, "vtp")
    vtp.write(vtp.network_lines(v, e, tortuous=False), folder)
    return rounded(vtp.read(v.sparkSession, folder).drop("document", "piece", "nth"), 6)


@query("SELECT ae.graph, eid, nkind::INT AS nkind, component, 1 AS is_major, major_tree_id, round(length, 6) AS length, diameter, 2::BIGINT AS n_points FROM ae JOIN trees USING (graph, component) WHERE is_major", TREES)
def labelled_edges(v, e):
    """The edges of major artery trees as straight segments with their labels."""
    e = materialize(e, "vessels")
    out = vtp.labelled_lines(v, e, topology.class_components(e, 2)[1], major=True)
    return rounded(out.withColumn("n_points", F.size("points").cast("long")).drop("points"), 6)


@query("SELECT graph, count(DISTINCT vid) FILTER (a AND c) AS n_frontier, count(DISTINCT vid) FILTER (v) AS n_venous, count(*) FILTER (a AND v) AS n_both FROM t GROUP BY graph", TOUCH)
def end_counts(v, e):
    t = topology.touches(e)
    return t.groupBy("graph").agg(F.count_if(F.col("artery") & F.col("capillary")).alias("n_frontier"), F.count_if("vein").alias("n_venous"), F.count_if(F.col("artery") & F.col("vein")).alias("n_both"))


@query("SELECT graph, vid, nkind_name || '_' || degree AS type FROM (SELECT graph, vid, CASE arg WHEN 2 THEN 'artery' WHEN 3 THEN 'vein' ELSE 'capillary' END AS nkind_name, degree FROM (SELECT graph, vid, sum(n) OVER (PARTITION BY graph, vid)::BIGINT AS degree, nkind AS arg, row_number() OVER (PARTITION BY graph, vid ORDER BY n DESC, nkind) AS nth FROM (SELECT graph, vid, nkind, count(*) AS n FROM inc GROUP BY ALL)) WHERE nth = 1)")
def majority_types(v, e):
    return topology.majority_types(e)


@query("""SELECT graph, artery_nodes, vein_nodes, ac_nodes, coalesce(u, 0) AS frontier_used, ac_nodes - coalesce(u, 0) AS frontier_unused, coalesce(r, 0) AS venous_reached, vein_nodes - coalesce(r, 0) AS venous_unreached FROM (SELECT graph, count(*) FILTER (a) AS artery_nodes, count(*) FILTER (v) AS vein_nodes, count(*) FILTER (a AND c) AS ac_nodes FROM t GROUP BY graph)
 LEFT JOIN (SELECT graph, count(DISTINCT source) AS u, count(DISTINCT target) AS r FROM s_p GROUP BY graph) USING (graph)""", TOUCH + "," + path_sql("s", "nkind <> 2", "length"))
def interface_use(v, e):
    """What the paths to the nearest veins use of the frontier and of the venous vertices."""
    e = vessels(e)
    out = paths.interface_use(topology.interfaces(e), paths.frontier_paths(e))
    return out.select("graph", "artery_nodes", "vein_nodes", "ac_nodes", "frontier_used", "frontier_unused", "venous_reached", "venous_unreached")


@query("""SELECT a.type, a.n AS n1, b.n AS n2, round(a.m, 4) AS mean1, round(b.m, 4) AS mean2, round((a.m - b.m) / nullif(sqrt(a.s / a.n + b.s / b.n), 0), 3) AS t, round((a.s / a.n + b.s / b.n) ^ 2 / nullif((a.s / a.n) ^ 2 / (a.n - 1) + (b.s / b.n) ^ 2 / (b.n - 1), 0), 3) AS df FROM bp a JOIN bp b USING (type) WHERE a.g = 'side' AND b.g = 'end'""", TYPES + "," + FACE + """,
 bn AS (SELECT graph, face, type, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY graph, face) AS pct FROM bc JOIN ty USING (graph, vid) GROUP BY graph, face, type), bp AS (SELECT type, CASE WHEN face LIKE 'z%' THEN 'end' ELSE 'side' END AS g, count(*) AS n, avg(pct) AS m, var_samp(pct) AS s FROM bn WHERE type <> 'unknown' GROUP BY ALL)""")
def boundary_percentages(v, e):
    """The vessel types at faces across z against those at the other faces."""
    shares = morphology.boundary_stats(morphology.boundary(v, e, morphology.face_vertices(v, BOX, 5.0)))
    out = boundary_tests(shares, F.when(F.col("face").startswith("z"), "end").otherwise("side"), "side", "end")
    return out.select("type", "n1", "n2", F.round("mean1", 4).alias("mean1"), F.round("mean2", 4).alias("mean2"), F.round("t", 3).alias("t"), F.round("df", 3).alias("df"))


@query("""SELECT eid, round(0.5 * (128 * sum(len) / (pi() * nullif(sum(128 * 1.63 * len / (pi() * (2 * 1.63 * (d + d2) / 4) ^ 4)), 0))) ^ 0.25 / 1.63, 6) AS radius FROM ms GROUP BY eid""")
def effective_radii(v, e):
    return e.select("eid", F.round(geometry.effective_radius(F.col("lengths2"), F.transform("diameters", lambda d: d / 2)), 6).alias("radius"))


@query("SELECT round(100 * (max(m) - min(m)) / median(m), 4) AS delta_pct FROM (SELECT graph, median(length) AS m FROM e GROUP BY graph)")
def median_spread(v, e):
    medians = stats.percentiles(materialize(e.select("graph", "length"), "lengths"), "length", ["graph"], {"median": 0.5})
    return rounded(stats.median_spread(medians, "median"))


@query("SELECT face, count(*) FILTER (graph = 'G0') AS \"G0\", count(*) FILTER (graph = 'G1') AS \"G1\", count(*) FILTER (graph = 'G2') AS \"G2\" FROM bc GROUP BY face", TYPES + "," + FACE)
def boundary_by_graph(v, e):
    """Vertices at each face in the first three graphs."""
    return morphology.boundary_by_graph(morphology.boundary(v, e, morphology.face_vertices(v, BOX, 5.0)), ["G0", "G1", "G2"])


@query("SELECT CASE nkind WHEN 2 THEN 'artery' WHEN 3 THEN 'vein' ELSE 'capillary' END AS type, count(*) AS n, round(avg(length), 6) AS mean, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3, round(min(length) FILTER (length >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(length) FILTER (length <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM e JOIN (SELECT nkind, quantile_cont(length, 0.25) AS q1, median(length) AS q2, quantile_cont(length, 0.75) AS q3 FROM e GROUP BY nkind) USING (nkind) GROUP BY nkind")
def box_plot_numbers(v, e):
    return rounded(stats.box_numbers(e.withColumn("type", label(F.col("nkind"))), "length", ["type"]), 6)


@query("SELECT graph, bool_and(least(x, y, z) >= 0) AS nodes_min_ok, bool_and(x <= 470 AND y <= 500 AND z <= 500) AS nodes_max_ok, any_value(lo) AS points_min_ok, any_value(hi) AS points_max_ok FROM v JOIN (SELECT graph, bool_and(least(x, y, z) >= 0) AS lo, bool_and(x <= 470 AND y <= 500 AND z <= 500) AS hi FROM pts GROUP BY graph) USING (graph) GROUP BY graph")
def inside_volume(v, e):
    return quality.inside_volume(v, e, (470.0, 500.0, 500.0))


@query("SELECT eid, round(sum(sqrt(((x2 - x) * 2) ^ 2 + ((y2 - y) * 2) ^ 2 + ((z2 - z) * 3) ^ 2)), 6) AS length, round(max(greatest(d, d2)) * 2, 6) AS diameter, 'um' AS space, 'network_um' AS folder FROM ms GROUP BY eid")
def converted_network(v, e):
    """A saved network in voxels converted to micrometres beside it, twice, and read."""
    spark = v.sparkSession
    folder = fresh(spark, "bundle") + "/network"
    bundle.save_network(v, e, folder, {"space": "voxels"})
    out = bundle.convert_network(spark, bundle.convert_network(spark, folder, (2.0, 2.0, 3.0)), (1.0, 1.0, 1.0))
    space = F.lit(spark.read.parquet(f"{out}/graph_meta").first()["space"])
    return rounded(bundle.load_network(spark, out)[1].select("eid", "length", "diameter", space.alias("space"), F.lit(out.rsplit("/", 1)[1]).alias("folder")), 6)


@query("SELECT p.source::DOUBLE AS eid, 4.0::DOUBLE AS nkind, 0.0::DOUBLE AS length, 0.0::DOUBLE AS diameter, len(path) AS n_points, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2 FROM s_p p JOIN v a ON a.graph = p.graph AND a.vid = source JOIN v b ON b.graph = p.graph AND b.vid = target", TOUCH + "," + path_sql("s", "nkind <> 2", "length"))
def vtp_paths(v, e):
    """The paths to the nearest veins as written to VTP documents and read back."""
    folder = fresh(v.sparkSession, "vtp")
    vtp.write(vtp.path_lines(paths.frontier_paths(vessels(e)), v), folder)
    return vtp.read(v.sparkSession, folder).drop("document", "piece", "nth")


@query("SELECT eid::DOUBLE AS eid, nkind::DOUBLE AS nkind, round(length, 6) AS length, diameter, 2::BIGINT AS n_points, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2 FROM e JOIN v a ON a.vid = src JOIN v b ON b.vid = dst WHERE nkind = 2")
def vtp_chosen_edges(v, e):
    """The edges of the artery class, chosen by id, as written and read back."""
    folder = fresh(v.sparkSession, "vtp")
    vtp.write(vtp.chosen_lines(v, e, e.where("nkind = 2").select("graph", "eid")), folder)
    return rounded(vtp.read(v.sparkSession, folder).drop("document", "piece", "nth"), 6)


def ontology_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ontology written as a JSON tree and as a CSV file, both read back, with the number of regions below each."""
    o = ontology(spark, sf_dir)
    folder = fresh(spark, "ontology")
    named = F.struct("id", "name", F.left("name", F.lit(3)).alias("acronym"))
    leaves = o.where("id < 1000").groupBy(F.col("parent_id").alias("id")).agg(F.collect_list(F.struct(named["id"].alias("id"), named["name"].alias("name"), named["acronym"].alias("acronym"))).alias("children"))
    middle = o.where("id between 1000 and 9998").join(leaves, "id", "left").groupBy(F.col("parent_id").alias("id")).agg(F.collect_list(F.struct("id", "name", F.left("name", F.lit(3)).alias("acronym"), "children")).alias("children"))
    root = o.where("id = 9999").join(middle, "id").agg(F.collect_list(F.struct("id", "name", F.left("name", F.lit(3)).alias("acronym"), "children")).alias("msg"))
    root.coalesce(1).write.json(f"{folder}/tree")
    o.coalesce(1).write.csv(f"{folder}/table", header=True)
    tree = materialize(bundle.load_region_tree(spark, f"{folder}/tree"), "tree")
    table = bundle.load_regions(spark, f"{folder}/table").select("id", F.col("parent_id").alias("csv_parent"), F.col("name").alias("csv_name"))
    return tree.join(table, "id", "full_outer").join(regions.subtree_sizes(tree), "id", "left")


QUERIES["ontology_files"] = ontology_files
ORACLES["ontology_files"] = """WITH o AS (SELECT r_regionkey::BIGINT + 1000 AS id, 9999::BIGINT AS parent_id, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_regionkey + 1000, n_name FROM nation UNION ALL SELECT 9999, NULL, 'root')
 SELECT id, parent_id, name, name[:3] AS acronym, parent_id AS csv_parent, name AS csv_name, CASE WHEN id = 9999 THEN (SELECT count(*) - 1 FROM o) ELSE (SELECT count(*) FROM o x WHERE x.parent_id = o.id) END::BIGINT AS n_below FROM o"""


@query("SELECT graph, face, count(*) AS n, min(distance_to_surface) AS min_depth, round(avg(distance_to_surface), 4) AS mean_depth, median(distance_to_surface) AS median_depth, max(distance_to_surface) AS max_depth FROM bc JOIN v USING (graph, vid) GROUP BY graph, face", TYPES + "," + FACE)
def boundary_depths(v, e):
    return rounded(morphology.boundary_depths(morphology.boundary(v, e, morphology.face_vertices(v, BOX, 5.0))))


@query("""SELECT graph, nv AS n_vertices, count(*) FILTER (is_major) || '/' || count(*) AS artery_trees, coalesce(max(printf('%d (%.1f%%)', n_edges, 100.0 * n_edges / te)) FILTER (major_tree_id = 1), 'N/A') AS artery_first_edges, coalesce(max(printf('%d (%.1f%%)', n_nodes, 100.0 * n_nodes / tn)) FILTER (major_tree_id = 1), 'N/A') AS artery_first_nodes
 FROM (SELECT *, sum(n_edges) OVER (PARTITION BY graph) AS te, sum(n_nodes) OVER (PARTITION BY graph) AS tn FROM trees) JOIN (SELECT graph, count(*) AS nv FROM v GROUP BY graph) USING (graph) GROUP BY graph, nv""", TREES)
def tree_table(v, e):
    """The artery trees of each graph as text for a table."""
    out = analysis.tree_table(v.groupBy("graph").agg(F.count("*").alias("n_vertices")), vessels(e))
    return out.select("graph", "n_vertices", "artery_trees", "artery_first_edges", "artery_first_nodes")
