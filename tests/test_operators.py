import base64
import heapq
import random
import re
import struct
import zlib
from itertools import product
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from vgraph.functions import stats
from vgraph.operators import clip, components, flow, paths, quality, skeleton, topology
from vgraph.operators.components import connected_components
from vgraph.plans.workspace import materialize
from vgraph.schema import EDGES, VERTICES
from vgraph.sources import bundle, columns, vtp


def plain_components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_at_once_and_in_rounds(spark, monkeypatch):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(180)] + [(7, 7), (900, 900)]
    want = plain_components([p for p in pairs if p[0] != p[1]])
    df = spark.createDataFrame([*pairs, (None, 3)], "src long, dst long")
    for small in (components.SMALL, 0):
        monkeypatch.setattr(components, "SMALL", small)
        assert {r[0]: r[1] for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def network(spark, places, links):
    v = spark.createDataFrame([("g", i, float(x), float(y), float(z), None, None, 0, None, None) for i, (x, y, z) in enumerate(places)], VERTICES)
    rows = []
    for k, (a, b, kind) in enumerate(links):
        p, q = ({c: float(n) for c, n in zip("xyz", places[i])} for i in (a, b))
        rows.append(("g", k, a, b, kind, 1.0, 4.0, [p, q], [4.0, 4.0], [1.0], [1.0, 1.0]))
    return v, spark.createDataFrame(rows, EDGES)


def test_cut_and_path_of_a_chain(spark):
    v, e = network(spark, [(i, 0, 0) for i in range(6)], [(0, 1, 2), (1, 2, 2), (2, 3, 4), (3, 4, 4), (4, 5, 3)])
    row = flow.min_cut(e).first()
    assert (row["cut_value"], row["n_disjoint"], row["paths"]) == (1.0, 1, [[2, 3, 4]])
    path = paths.frontier_paths(e).first()
    assert (path["source"], path["target"], path["dist"], path["path"]) == (2, 4, 2.0, [2, 3, 4])
    _, two = network(spark, [(i, 0, 0) for i in range(6)], [(0, 1, 2), (1, 2, 4), (2, 4, 4), (1, 3, 4), (3, 4, 4), (4, 5, 3)])
    row = flow.min_cut(two).first()
    assert (row["cut_value"], row["n_disjoint"], row["cut_edges"]) == (2.0, 2, [1, 3])
    _, none = network(spark, [(0, 0, 0), (1, 0, 0)], [(0, 1, 2)])
    row = flow.min_cut(none).first()
    assert row["cut_value"] is None and row["n_disjoint"] == 0


def test_cut_where_arteries_and_veins_meet(spark):
    # three arteries lead into vertex 3, one vein leads on: a cut of the vein's edge is the least
    _, e = network(spark, [(i, 0, 0) for i in range(5)], [(0, 3, 2), (1, 3, 2), (2, 3, 2), (3, 4, 3)])
    row = flow.min_cut(e).first()
    assert (row["cut_value"], row["n_cut"], row["n_disjoint"], row["cut_edges"]) == (6.0, 1, 1, [3])
    rng = random.Random(8)
    for _ in range(6):
        links = [(rng.randrange(7), rng.randrange(7), rng.choice((2, 3, 4, 4, 4))) for _ in range(12)]
        touch = {k: {x for a, b, c in links if c == k for x in (a, b)} for k in (2, 3)}
        both = touch[2] & touch[3]
        least = lambda first, last: min(sum((a in side) != (b in side) for a, b, _ in links) for n in range(1 << 7) if first <= (side := {i for i in range(7) if n >> i & 1}) and not side & last)
        row = flow.min_cut(network(spark, [(i, 0, 0) for i in range(7)], links)[1]).first()
        if not touch[2] or not touch[3]:
            assert row["cut_value"] is None and row["n_disjoint"] == 0
            continue
        cut = least(touch[2] - both, touch[3] - both)
        assert (row["cut_value"], row["n_cut"], len(row["cut_edges"])) == (cut + len(both) * (len(links) + 1), cut, cut)
        assert row["n_disjoint"] == len(row["paths"]) == least(touch[2], touch[3] - both)


def plain_paths(edges, arteries, weight):
    """{source: (distance, edges, target)} by the definition: Dijkstra's distances to veins, then fewest edges, then the smallest target."""
    touch = {k: {x for e in edges if e["nkind"] == k for x in (e["src"], e["dst"])} for k in (2, 3, 4)}
    near = {}
    for e in edges:
        if arteries or e["nkind"] != 2:
            near.setdefault(e["src"], []).append((e["dst"], weight(e)))
            near.setdefault(e["dst"], []).append((e["src"], weight(e)))
    out = {}
    for s in touch[2] & touch[4]:
        best, heap = {}, [(0.0, 0, s)]
        while heap:
            d, n, v = heapq.heappop(heap)
            d = round(d, 6)
            if v in best:
                continue
            best[v] = (d, n)
            for w, x in near.get(v, ()):
                heapq.heappush(heap, (round(d + x, 6), n + 1, w))
        ends = [(*best[v], v) for v in touch[3] if v in best]
        if ends:
            out[s] = min(ends)
    return out


def test_cuts_of_large_graphs_by_rounds(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(f"g{g}", k, rng.randrange(14), rng.randrange(14), rng.choice((2, 3, 4, 4, 4, 4, 4, 4))) for g in range(7) for k in range(26)]
    rows += [("arteries", 0, 1, 2, 2), ("apart", 0, 1, 2, 2), ("apart", 1, 3, 4, 3), ("loop", 0, 1, 1, 4)]
    e = spark.createDataFrame(rows, "graph string, eid long, src long, dst long, nkind int")
    want = {r["graph"]: r.asDict() for r in flow.min_cut(e).collect()}
    monkeypatch.setattr(flow, "ONE_TASK", 0)
    got = {r["graph"]: r.asDict() for r in flow.min_cut(e).collect()}
    assert {g: {**r, "paths": len(r["paths"])} for g, r in got.items()} == {g: {**r, "paths": len(r["paths"])} for g, r in want.items()}
    assert max(r["n_disjoint"] for r in got.values()) > 1
    for g, r in got.items():
        links = [(a, b) for x, _, a, b, _ in rows if x == g]
        touch = {k: {v for x, _, a, b, c in rows if x == g and c == k for v in (a, b)} for k in (2, 3)}
        for path in r["paths"]:
            assert path[0] in touch[2] and path[-1] in touch[3] - touch[2]
            for a, b in zip(path, path[1:]):
                links.remove((a, b) if (a, b) in links else (b, a))


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_paths_to_the_nearest_vein(spark, monkeypatch, one_task):
    monkeypatch.setattr(paths, "ONE_TASK", one_task)
    rng = random.Random(6)
    places = [(x, y, 0) for y in range(5) for x in range(6)]
    at = lambda x, y: y * 6 + x
    links = [(at(x, y), at(x + 1, y), 2 if y == 0 else 3 if y == 4 else 4) for y in range(5) for x in range(5)] + [(at(x, y), at(x, y + 1), 4) for y in range(4) for x in range(6) if rng.random() < 0.8]
    _, e = network(spark, places, links)
    e = e.withColumn("length", 1.0 + F.col("eid") % 3)
    rows = [r.asDict() for r in e.collect()]
    length = {}
    for r in rows:
        key = frozenset((r["src"], r["dst"]))
        length[key] = min(length.get(key, 1e9), r["length"])
    for found, arteries, weight in ((paths.frontier_paths(e), False, lambda r: r["length"]), (paths.frontier_paths(paths.with_penalties(e), True, "w_cap_prior"), True, lambda r: r["length"] + (1e5 if r["nkind"] != 4 else 0))):
        want = plain_paths(rows, arteries, weight)
        got = {r["source"]: r for r in found.collect()}
        assert set(got) == set(want)
        for s, r in got.items():
            assert (round(r["dist"], 6), len(r["path"]) - 1, r["target"]) == want[s]
            assert r["path"][0] == s and r["path"][-1] == r["target"]
            if not arteries:
                assert abs(sum(length[frozenset(p)] for p in zip(r["path"], r["path"][1:])) - r["dist"]) < 1e-6


def test_nearest_veins_by_buckets_and_in_one_task(spark, monkeypatch):
    """Ties within the tolerance count at the end alone, so they don't add up over edges."""
    rng = random.Random(4)
    rows = [(f"g{g}", k, rng.randrange(30), rng.randrange(30), rng.choice((2, 3, 4, 4, 4, 4, 4, 4)), rng.choice((1.0, 2.0, 3.0)) + rng.choice((0, 0, 4e-7))) for g in range(5) for k in range(45)]
    # each of ten steps has a way of one edge that is 0.6 of the tolerance longer than that of two
    rows += [("sum", k, k, k + 1, 4, 2.0 + 6e-7) for k in range(10)] + [("sum", 20 + 2 * k + i, (k, 100 + k)[i], (100 + k, k + 1)[i], 4, 1.0) for k in range(10) for i in (0, 1)]
    rows += [("sum", 60, 10, 11, 3, 1.0), ("sum", 61, 0, 12, 2, 1.0), ("alone", 0, 1, 2, 3, 1.0), ("loop", 0, 1, 1, 4, 1.0), ("null", 0, 1, 2, 3, 1.0), ("null", 1, 2, 3, 4, None)]
    e = spark.createDataFrame(rows, "graph string, eid long, src long, dst long, nkind int, length double").withColumn("diameter", F.lit(1.0))
    wanted = e.select("graph", F.col("src").alias("vid")).distinct()
    found = []
    for small in (paths.ONE_TASK, 0):
        monkeypatch.setattr(paths, "ONE_TASK", small)
        found.append({(r["graph"], r["vid"]): r.asDict() for r in paths.nearest_venous(e, tol=1e-6, wanted=wanted).collect()})
    assert found[0] == found[1]
    assert ("null", 3) not in found[0] and ("loop", 1) not in found[0]
    for (g, v), r in found[0].items():
        near = {}
        for x, _, a, b, _, w in rows:
            if x == g and w is not None:
                near.setdefault(a, []).append((b, w))
                near.setdefault(b, []).append((a, w))
        veins = {y for x, _, a, b, k, _ in rows if x == g and k == 3 for y in (a, b)}
        # the least length by number of edges
        best, least = {v: 0.0}, []
        for hops in range(40):
            least += [(best[t], hops, t) for t in veins if t in best]
            nxt = {}
            for a, d in best.items():
                for b, w in near.get(a, ()):
                    nxt[b] = min(nxt.get(b, 1e9), d + w)
            best = nxt
        want = min(d for d, _, _ in least)
        assert abs(r["dist"] - want) < 1e-9
        assert (r["hops"], r["target"]) == min((h, t) for d, h, t in least if d <= want + 1e-6)
        if r["path"]:
            assert r["path"][0] == v and r["path"][-1] == r["target"] and len(r["path"]) == r["hops"] + 1
            assert r["after"] == (r["path"][1] if r["hops"] else None)
            length = sum(min(w for b2, w in near[a] if b2 == b) for a, b in zip(r["path"], r["path"][1:]))
            assert length <= want + 1e-6 + 1e-9


def test_ids_that_repeat_between_graphs(spark):
    v = spark.createDataFrame([(g, i) for g in "ab" for i in range(4)], "graph string, vid long")
    e = spark.createDataFrame([("a", 0, 0, 1), ("b", 0, 1, 2), ("b", 1, 2, 3)], "graph string, eid long, src long, dst long").withColumns({"nkind": F.lit(2), "length": F.lit(1.0), "diameter": F.lit(1.0)})
    got = {(r["graph"], r["vid"]): r["component"] for r in topology.components(v, e).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 2, ("a", 3): 3, ("b", 0): 0, ("b", 1): 1, ("b", 2): 1, ("b", 3): 1}
    gv, ge = topology.giant_component(v, e)
    assert sorted(map(tuple, gv.collect())) == [("a", 0), ("a", 1), ("b", 1), ("b", 2), ("b", 3)] and ge.count() == 3
    table, _ = topology.class_components(e, 2)
    assert sorted((r["graph"], r["component"], r["n_edges"]) for r in table.collect()) == [("a", 0, 1), ("b", 1, 2)]


def test_each_vtp_file_is_one_document(spark, tmp_path):
    v, e = network(spark, [(i, i % 3, 0) for i in range(60)], [(i, i + 1, 4) for i in range(59)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        vtp.write(vtp.lines(v, e).repartition(3), str(tmp_path / "lines"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    n = 0
    for f in (tmp_path / "lines").glob("part-*"):
        root = ElementTree.fromstring(f.read_text())
        pieces = root.findall("./PolyData/Piece")
        assert len(pieces) > 1
        n += sum(int(p.get("NumberOfLines")) for p in pieces)
    assert n == 59


def test_ranges_that_break_at_any_edge(spark):
    r = spark.createDataFrame([(999_998, 0, 2), (999_999, 2, 4), (1_000_000, 5, 6), (1_000_001, 6, 7)], "eid long, start long, end long")
    assert [tuple(x) for x in quality.ranges_adjoin(r).collect()] == [(1_000_000, 5, 6, 4)]


def test_bundle_of_several_files_keeps_its_rows(spark, tmp_path):
    spark.range(1000).selectExpr("id * 1.5 x", "0.0 y", "id z").repartitionByRange(6, "z").sortWithinPartitions("z").write.csv(str(tmp_path / "coordinates.csv"))
    got = bundle.rows(spark, str(tmp_path), "coordinates").collect()
    assert len(got) == 1000 and all(r["z"] == r["row"] and r["x"] == 1.5 * r["row"] for r in got)


def test_clip_cuts_at_the_face_and_twice_is_once(spark):
    v, e = network(spark, [(0, 0, 0), (4, 0, 0), (9, 0, 0), (12, 0, 0)], [(0, 1, 4), (2, 1, 4), (2, 3, 4)])
    box = {"xmin": -1.0, "xmax": 6.0, "ymin": -1.0, "ymax": 1.0, "zmin": -1.0, "zmax": 1.0}
    cv, ce = clip.cut(v, e, box)
    border = cv.where("is_border = 1").collect()
    assert [(r["x"], r["border_face"]) for r in border] == [(6.0, "x_max")]
    assert sorted(r["length"] for r in ce.collect()) == [1.0, 2.0]
    again, ae = clip.cut(cv, ce, box)
    assert again.count() == cv.count() and ae.count() == ce.count()


def test_skeleton_of_a_bar_a_cross_a_ring_and_points(spark):
    bar = [(20, y, 3) for y in range(5)]
    # a cross in a plane: its middle and the four beside it touch each other and are one node, each arm keeps two voxels
    cross = [(4, 4, 0)] + [(4 + dx * k, 4 + dy * k, 0) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) for k in (1, 2, 3)]
    ring = [(30, 0, 0), (31, 1, 0), (30, 2, 0), (29, 1, 0)]
    points = [(50, 50, 50), (60, 0, 9)]
    parts = skeleton.to_graph(spark.createDataFrame(bar + cross + ring + points, "x long, y long, z long"))
    links = parts["links"].collect()
    assert [len(r["voxels"]) for r in parts["nodes"].collect()] == [5]
    assert parts["endpoints"].count() == 6 and parts["isopoints"].count() == 2
    assert [len(r["voxels"]) for r in links if r["is_loop"]] == [4]
    arms = [r for r in links if r["nodes"] == [1]]
    assert [len(r["voxels"]) for r in arms] == [1] * 4 and all(len(r["endpoints"]) == 1 for r in arms)
    assert [len(r["voxels"]) for r in links if len(r["endpoints"]) == 2] == [3]


def test_t_probabilities():
    # from tables of Student's t distribution
    for t, df, p in ((2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 1e6, 0.05), (0.0, 5, 1.0)):
        assert abs(stats.student_p(t, df) - p) < 2e-4


def test_stars_and_text(spark):
    df = spark.createDataFrame([(0.00001,), (0.004,), (0.2,), (None,)], "p double")
    got = df.select(stats.p_stars(F.col("p")), stats.p_text(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("****", "p<0.001"), ("**", "p=0.004"), ("ns", "p=0.200"), ("", "n/a")]
    got = df.select(stats.p_stars(F.col("p"), 3), stats.p_class(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("***", "p<1e-4"), ("**", "p<0.01"), ("ns", "ns (p=0.20)"), ("NA", "p=NA")]


def test_a_path_that_lacks_an_edge_has_none(spark):
    _, e = network(spark, [(i, 0, 0) for i in range(5)], [(0, 1, 4), (1, 2, 4), (1, 0, 3), (3, 4, 4)])
    found = spark.createDataFrame([("g", 0, [0, 1, 2]), ("g", 1, [1, 2, 3]), ("g", 2, [2])], "graph string, source long, path array<long>")
    assert sorted(tuple(r)[1:4] for r in paths.path_edges(found, e).collect()) == [(0, 0, 0), (0, 1, 1)]


def test_seeded_samples_and_synced_columns(spark):
    found = spark.createDataFrame([(g, k, k + 1) for g in "ab" for k in range(20)], "graph string, source long, target long")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(paths.sample_paths(found, 3)) == [(g, k, k + 1) for g in "ab" for k in range(3)]
    one = rows(paths.sample_paths(found, 5, seed=1))
    assert len(one) == 10 and one == rows(paths.sample_paths(found.repartition(7), 5, seed=1)) != rows(paths.sample_paths(found, 5, seed=2))
    v = spark.createDataFrame([("a", 0, 9.0), ("a", 1, 9.0), ("b", 0, 9.0)], "graph string, vid long, r double")
    new = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0), ("b", 1, 4.0)], "graph string, vid long, r double")
    assert sorted(map(str, quality.synced(v, new, ["r"]).collect())) == ["Row(graph='a', vid=0, r=1.0)", "Row(graph='a', vid=1, r=2.0)", "Row(graph='b', vid=0, r=None)"]


def plain_chains(voxels):
    """The link voxels' chains in order: from the smaller end, or round a loop from its smallest voxel to the smaller beside it."""
    number = {v: k for k, v in enumerate(sorted(voxels))}
    near = {number[v]: [number[w] for o in product((-1, 0, 1), repeat=3) if any(o) and (w := tuple(a + b for a, b in zip(v, o))) in number] for v in voxels}
    link = {v for v, n in near.items() if len(n) == 2}
    inner = {v: sorted(w for w in near[v] if w in link) for v in link}
    out, done = [], set()
    for ends in (sorted(v for v in link if len(inner[v]) < 2), sorted(link)):
        for v in ends:
            if v not in done:
                chain = [v]
                done.add(v)
                while step := [w for w in inner[chain[-1]] if w not in done]:
                    chain.append(step[0])
                    done.add(step[0])
                out.append(chain)
    return sorted(out)


def test_chains_in_order(spark):
    rng = random.Random(2)
    voxels = set()
    for k in range(60):
        x, y, z = 40 * (k % 8), 40 * (k // 8), 0
        for _ in range(rng.randint(1, 30)):
            voxels.add((x, y, z))
            d = rng.choice(((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, -1)))
            x, y, z = x + d[0], y + d[1], z + d[2]
    for k in range(5):  # rings of growing size
        n = 3 + 2 * k
        voxels |= {(400 + 40 * k + i, j, 0) for i in range(n + 1) for j in (0, n)} - {(400 + 40 * k, 0, 0), (400 + 40 * k + n, 0, 0), (400 + 40 * k, n, 0), (400 + 40 * k + n, n, 0)}
        voxels |= {(400 + 40 * k + i, j, 0) for i in (0, n) for j in range(1, n)}
    voxels |= {(x, 500, 0) for x in range(3000)}
    parts = skeleton.to_graph(spark.createDataFrame(sorted(voxels), "x long, y long, z long"))
    got = sorted(r["voxels"] for r in parts["links"].where("link is not null").collect())
    assert got == plain_chains(voxels)
    assert sum(r["is_loop"] for r in parts["links"].collect()) >= 5
    ordered = parts["link_voxels"].groupBy("link").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.count_distinct("at").alias("d")).collect()
    assert all(r["n"] == r["last"] + 1 == r["d"] for r in ordered)


@pytest.mark.parametrize(("bins", "few"), [(4096, 4096), (64, 20)])
def test_percentiles_by_refined_histograms(spark, monkeypatch, bins, few):
    monkeypatch.setattr(stats, "BINS", bins)
    monkeypatch.setattr(stats, "FEW", few)
    rng = random.Random(13)
    groups = {"normal": [rng.gauss(0, 1) for _ in range(300)], "ties": [float(rng.randrange(4)) for _ in range(200)], "one": [5.0], "two": [1.0, 2.0], "same": [3.0] * 50, "wide": [10.0 ** rng.uniform(-300, 300) * rng.choice((-1, 1)) for _ in range(100)], "ends": [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323] * 4, None: [rng.random() for _ in range(40)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("one", None), ("one", float("nan")), ("one", float("inf")), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    at = {"p0": 0.0, "p5": 0.05, "median": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in stats.percentiles(df, "x", ["g"], at).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs = sorted(xs)
        for name, p in at.items():
            k = int(p * (len(xs) - 1))
            part = p * (len(xs) - 1) - k
            want = xs[k] if not part else (1 - part) * xs[k] + part * xs[k + 1]
            assert got[g][name] == pytest.approx(want, rel=1e-12, abs=1e-320)
    assert stats.percentiles(df.limit(0), "x", ["g"], at).count() == 0


@pytest.mark.parametrize("rows", [200_000, 7])
def test_running_sums_by_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(stats, "RANGE", rows)
    rng = random.Random(14)
    counts = {(g, float(x)): rng.randint(1, 9) for g in ("a", "b", None) for x in rng.sample(range(100), 40)}
    df = spark.createDataFrame([(g, x, n) for (g, x), n in counts.items()], "g string, x double, n long")
    got = {(r["g"], r["x"]): (r["n"], r["sum_n"], r["all_n"]) for r in stats.running(df, ["g"], "x", ["n"]).collect()}
    assert got == {(g, x): (n, sum(m for (h, y), m in counts.items() if h == g and y <= x), sum(m for (h, _), m in counts.items() if h == g)) for (g, x), n in counts.items()}
    assert stats.running(df.limit(0), ["g"], "x", ["n"]).count() == 0


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_files_read_side_by_side(spark, tmp_path, monkeypatch, size):
    """Ranges that end amid lines, files of several parts, a last line without an end."""
    monkeypatch.setattr(columns, "COUNTED", size)
    monkeypatch.setattr(columns, "READ", 5 * size)
    rng = random.Random(3)
    xs = [(rng.choice((0.5, 123456.75, -1.0)), float(k)) for k in range(60)]
    ys = [rng.choice((1.0, 22222.0)) for _ in xs]
    (tmp_path / "xs.csv").write_text("\n".join(f"{a},{b}" for a, b in xs))
    (tmp_path / "ys.csv").mkdir()
    for part, (a, b) in enumerate(((0, 7), (7, 7), (7, 41), (41, 60))):
        (tmp_path / "ys.csv" / f"part-{part}.csv").write_text("".join(f"{y}\n" for y in ys[a:b]))
    (tmp_path / "ys.csv" / "_SUCCESS").write_text("")
    got = sorted(tuple(r) for r in columns.read(spark, str(tmp_path), {"xs": ["a", "b"], "ys": ["y"]}).collect())
    assert got == [(k, *x, y) for k, (x, y) in enumerate(zip(xs, ys))]
    (tmp_path / "short.csv").write_text("1\n2\n")
    with pytest.raises(ValueError):
        columns.read(spark, str(tmp_path), {"xs": ["a", "b"], "short": ["c"]})
    with pytest.raises(FileNotFoundError):
        columns.read(spark, str(tmp_path), {"none": ["c"]})


def test_files_written_side_by_side(spark, tmp_path):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 k", "id * 1.5 x", "cast(id as int) n").repartition(5)
    columns.write(df, str(tmp_path), {"x.csv": ["x"], "kn.csv": ["k", "n"]}, "k")
    columns.write(df, str(tmp_path), {"x.csv": ["x"], "kn.csv": ["k", "n"]}, "k")
    got = columns.read(spark, str(tmp_path), {"x": ["x"], "kn": ["k", "n"]}).orderBy("row").collect()
    want = {r["k"]: r for r in df.collect()}
    assert [(r["k"], r["x"], r["n"]) for r in got] == [(k, float(want[k]["x"]), want[k]["n"]) for k in range(1000)]
    assert not list(tmp_path.glob("_temporary*"))


def test_neighbours_across_bricks(spark, monkeypatch):
    rng = random.Random(21)
    voxels = {(rng.randint(-70, -58), rng.randint(-3, 3), rng.randint(60, 68)) for _ in range(500)}
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(sorted(voxels))], "id long, x long, y long, z long")
    number = {v: k for k, v in enumerate(sorted(voxels))}
    want = sorted((k, number[w]) for v, k in number.items() for o in product((-1, 0, 1), repeat=3) if any(o) and (w := tuple(a + b for a, b in zip(v, o))) in number)
    for bucket in (skeleton.BUCKET, 40):
        monkeypatch.setattr(skeleton, "BUCKET", bucket)
        assert sorted(tuple(r) for r in skeleton.adjacency(df).collect()) == want
    assert skeleton.adjacency(df.limit(0)).count() == 0


def test_rows_of_files_are_not_joined_through_the_driver(spark, tmp_path):
    for name in ("radii", "annotation"):
        (tmp_path / f"{name}.csv").write_text("".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 5000)
    try:
        both = bundle.rows(spark, str(tmp_path), "radii").join(bundle.rows(spark, str(tmp_path), "annotation"), "row").where("radius = annotation and radius = row")
        assert len(both.collect()) == 5000
        # the plan as it ran
        assert "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_files_of_many_rows_are_not_joined_through_the_driver(spark):
    rows = materialize(spark.range(3_000_000).select(F.lit("G").alias("graph"), F.col("id")), "rows")
    both = rows.join(rows.withColumnRenamed("graph", "other"), "id")
    assert "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString()


def test_hops_of_small_graphs_in_parts_and_of_large_ones_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    pairs = {g: [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for g, n, m in (("a", 40, 60), ("b", 25, 20), ("c", 30, 90))}
    e = spark.createDataFrame([(g, a, b) for g, ps in pairs.items() for a, b in ps], "graph string, src long, dst long")
    sources, targets = (spark.createDataFrame([(g, v) for g in "abc" for v in range(k, 42, 3)], "graph string, vid long") for k in (0, 1))
    sources = sources.unionByName(targets.where("vid < 8"))
    want = {}
    for g, ps in pairs.items():
        near = {}
        for a, b in ps:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for s in {r["vid"] for r in sources.where(F.col("graph") == g).collect()}:
            best, front = {s: (s,)}, [s]
            while front:
                new = {}
                for v in front:
                    for w in near.get(v, ()):
                        if w not in best:
                            new[w] = min(new.get(w, (1 << 30,)), (*best[v], w))
                best |= new
                front = list(new)
            want |= {(g, s, t): list(p) for t, p in best.items() if t % 3 == 1 and t != s}
    asked = spark.createDataFrame([k for k in want if k[1] % 2], "graph string, source long, target long")
    writes = []
    add = paths.Rounds.add
    monkeypatch.setattr(paths.Rounds, "add", lambda self, rows: writes.append(1) or add(self, rows))
    for task, cells in ((20_000, 300), (150, 500)):
        monkeypatch.setattr(paths, "HOP_TASK", task)
        monkeypatch.setattr(paths, "CELLS", cells)
        writes.clear()
        assert {(r["graph"], r["source"], r["target"]): r["path"] for r in paths.hop_paths(e, sources, targets).collect()} == want
        assert {(r["graph"], r["source"], r["target"]): r["hops"] for r in paths.hop_distances(e, sources, targets).collect()} == {k: len(p) - 1 for k, p in want.items()}
        # small graphs write no table a round
        assert bool(writes) == (task < 20_000)
    monkeypatch.undo()
    assert {tuple(r)[:3] for r in paths.hop_paths(e, sources, targets, asked).collect()} == {k for k in want if k[1] % 2}


def test_saved_networks_have_a_file_for_a_graph_not_for_a_task(spark, tmp_path):
    v = spark.range(400).select(F.concat(F.lit("g"), F.col("id") % 5).alias("graph"), F.col("id").alias("vid")).repartition(8)
    e = v.select("graph", F.col("vid").alias("eid")).repartition(8)
    bundle.save_network(v, e, str(tmp_path / "net"))
    for table in ("vertices", "edges"):
        assert sorted(len(list(d.glob("part-*.parquet"))) for d in (tmp_path / "net" / table).glob("graph=*")) == [1] * 5
    assert bundle.load_network(spark, str(tmp_path / "net"), "g3")[1].count() == 80


def test_components_of_many_small_graphs_take_no_rounds(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, rng.randrange(40), rng.randrange(40)) for g in "abc" for _ in range(30)]
    rows += [("a", 7, None), ("d", 5, 5), (None, 1, 2)]
    e = spark.createDataFrame(rows, "graph string, src long, dst long")
    want = {(g, v): c for g in "abc" for v, c in plain_components([(a, b) for h, a, b in rows if h == g and b is not None and a != b]).items()}
    got = lambda: {(r["graph"], r["vid"]): r["component"] for r in topology.edge_components(e.where("graph is not null")).collect()}
    e = e.where("graph <> 'a' or src % 5 > 0")
    want = {k: c for k, c in want.items() if k[0] != "a"} | {("a", v): c for v, c in plain_components([(a, b) for h, a, b in rows if h == "a" and b is not None and a != b and a % 5]).items()}
    rounds = []
    one = components._round
    monkeypatch.setattr(components, "_round", lambda stars: rounds.append(1) or one(stars))
    monkeypatch.setattr(components, "SMALL", 30)  # all edges together are more, those of a graph are not
    assert got() == want and not rounds
    monkeypatch.setattr(components, "SMALL", 26)
    assert got() == want and rounds


def test_ranges_are_not_joined_through_the_driver(spark):
    ranges = materialize(spark.range(2_000_000).select(F.col("id").alias("eid"), (3 * F.col("id")).alias("start"), (3 * F.col("id") + 3).alias("end")), "ranges")
    assert "BroadcastHashJoin" not in quality.ranges_adjoin(ranges)._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_merged_whatever_size_they_are_taken_for(spark):
    """The plan that has run may hold no broadcast; few edges stand for many that a plan takes for few."""
    sizes = {eid: eid % 4 + 1 for eid in (*range(5, 60, 2), 71, 300)}
    e = spark.createDataFrame([(eid, [(0.0,)] * n) for eid, n in sizes.items()], "eid long, points array<struct<x double>>").repartition(3)
    r = bundle.ranges(e, 7)
    want, start = [], 0
    for eid, (old, n) in enumerate(sorted(sizes.items())):
        want.append((old, eid, start, start := start + n))
    assert sorted(tuple(x) for x in r.collect()) == want
    moved = quality.ranges_adjoin(r.select("eid", (F.col("start") + (F.col("eid") % 10 == 3).cast("int")).alias("start"), "end"))
    assert sorted(tuple(x) for x in moved.collect()) == [(eid, a + 1, b, a) for _, eid, a, b in want if eid % 10 == 3]
    for df in (r, moved):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_graph_without_shared_terminals_takes_one_flow(monkeypatch):
    import pandas as pd

    calls, real = [], flow._flow
    monkeypatch.setattr(flow, "_flow", lambda *a: calls.append(1) or real(*a))
    rows = [(1, 1, 2, 2), (2, 2, 3, 4), (3, 2, 3, 4), (4, 3, 4, 3)]
    got = flow._cut(pd.DataFrame([("G", *r) for r in rows], columns=["graph", "eid", "src", "dst", "nkind"])).iloc[0]
    assert (got.cut_value, got.n_cut, got.cut_edges, got.n_disjoint) == (2.0, 2, [2, 3], 2)
    assert len(calls) == 1


def test_box_numbers_do_not_sort_a_group_in_one_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(400_000))
    try:
        out = stats.box_numbers(spark.range(60_000).selectExpr("id % 3 AS type", "sqrt(id * 7919 % 60000) AS x"), "x", ["type"])
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["n"] for r in out.collect()} == {20_000}


def test_voxel_links_make_the_lattice_once(spark):
    from vgraph.queries import QUERIES

    assert not any("orders" in f for f in QUERIES["voxel_links"](spark, "/root/testdata/sf0.001").inputFiles())


def test_vtp_values_stay_exact_and_small(spark, tmp_path):
    line = spark.range(3000).selectExpr("array(named_struct('x', id / 3, 'y', 0.1D + 0.2D, 'z', -id / 7), named_struct('x', id + 1.0D, 'y', 1e-300D, 'z', double('NaN'))) AS points", "array(named_struct('n', id / 11, 'half', 0.5D)) AS cells").repartition(2)
    vtp.write(line, str(tmp_path / "lines"))
    got = sorted((r["x1"], r["y1"], r["z1"], r["x2"], r["y2"], r["n"], r["half"], r["n_points"]) for r in vtp.read(spark, str(tmp_path / "lines")).where("isnan(z2)").collect())
    assert got == [(k / 3, 0.1 + 0.2, -k / 7, k + 1.0, 1e-300, k / 11, 0.5, 2) for k in range(3000)]
    # 11 numbers of 8 bytes a line, of which plain text takes 22 each
    assert sum(f.stat().st_size for f in (tmp_path / "lines").glob("part-*")) < 100 * 3000


def test_vtp_arrays_of_several_blocks_or_of_text_are_read():
    want = [k / 3 for k in range(10)]
    raw = struct.pack("<10d", *want)
    blocks = [zlib.compress(raw[:64]), zlib.compress(raw[64:])]
    head = struct.pack("<5Q", 2, 64, 16, *map(len, blocks))
    array = lambda form, text: ElementTree.fromstring(f'<DataArray format="{form}">\n{text}\n</DataArray>')
    assert vtp._values(array("binary", (base64.b64encode(head) + base64.b64encode(b"".join(blocks))).decode()), "<f8").tolist() == want
    assert vtp._values(array("ascii", " ".join(map(repr, want))), "<f8").tolist() == want
    for n in (0, 1, 7):
        assert vtp._values(array("binary", vtp._packed(np.arange(n))), "<i8").tolist() == list(range(n))


def test_places_in_graphs_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANGE", 7)
    rng = random.Random(4)
    keys = {g: rng.sample(range(-500, 500), n) for g, n in (("a", 40), ("b", 1), ("c", 23), ("", 3))}
    rows = [(g, k, 2 * k) for g, ks in keys.items() for k in ks]
    rng.shuffle(rows)
    got = vtp.numbered(spark.createDataFrame(rows, "graph string, k long, more long"), "k")
    assert sorted(map(tuple, got.collect())) == sorted((g, k, 2 * k, sorted(keys[g]).index(k)) for g, k, _ in rows)


def test_points_of_drawn_edges_are_shuffled_once(spark):
    v, e = network(spark, [(i, i % 3, 0) for i in range(60)] + [(59, 2, 0)], [(i, i + 1, 4) for i in range(60)] + [(5, 5, 4)])
    e = materialize(e, "lattice")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = vtp.network_lines(v, e)
        plan = spark._jvm.PythonSQLUtils.explainString(lines._jdf.queryExecution(), "formatted")
        # vertices 59 and 60 are one place, so the last edge goes, as does the loop
        assert sorted((r["eid"], r["points"][0]["index"], r["points"][-1]["index"], r["cells"][0]["index"]) for r in lines.collect()) == [(i, i, i + 1, i) for i in range(59)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(exchanges) > 2 and sum("points#" in x for x in exchanges) == 1
