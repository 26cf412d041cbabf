"""Networks from a folder of headerless CSV files whose row order is the key, and tables back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vgraph.functions.geometry import finite_max, oriented, per_point, segments, to_um, tortuosity, total
from vgraph.plans.workspace import materialize
from vgraph.schema import finite, require_columns
from vgraph.sources import columns

#: Name, columns: by vertex, by edge, by point.
FILES = {
    "vertices": ["id"], "coordinates": ["x", "y", "z"], "coordinates_atlas": ["ax", "ay", "az"], "radii": ["radius"], "annotation": ["annotation"], "distance_to_surface": ["distance_to_surface"],
    "edges": ["src", "dst"], "length": ["steps"], "radii_edge": ["edge_radius"], "artery": ["artery"], "vein": ["vein"], "edge_geometry_indices": ["start", "end"],
    "edge_geometry_coordinates": ["x", "y", "z"], "edge_geometry_radii": ["r"],
}


def rows(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """(row, columns as doubles) of one file or of several side by side; ``row`` counts from 0 in the files' order."""
    return columns.read(spark, folder, {name: FILES[name] for name in names})


def load(spark: SparkSession, folder: str, graph: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): classes from the artery and vein flags, artery first; polylines turned to their source; the largest
    finite diameter for an edge, twice the radius for a vertex."""
    v = rows(spark, folder, "coordinates", "vertices", "radii", "annotation", "distance_to_surface")
    v = v.select(F.lit(graph).alias("graph"), F.col("id").cast("long").alias("vid"), "x", "y", "z", (2 * finite(F.col("radius"))).alias("diameter"), F.col("annotation").cast("long").alias("annotation"), finite(F.col("distance_to_surface")).alias("distance_to_surface"))
    e = rows(spark, folder, "edges", "artery", "vein", "edge_geometry_indices")
    nkind = F.when(F.col("artery") == 1, 2).when(F.col("vein") == 1, 3).otherwise(4)
    e = e.select(F.col("row").alias("eid"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), nkind.alias("nkind"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    points = rows(spark, folder, "edge_geometry_coordinates", "edge_geometry_radii")
    held = e.where("start < end").select("eid", F.explode(F.sequence("start", F.col("end") - 1)).alias("row")).join(points, "row")
    lines = held.groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("row", "x", "y", "z", "r"))).alias("ps"))
    e = e.join(lines, "eid").join(v.select(F.col("vid").alias("src"), F.struct("x", "y", "z").alias("source")), "src")
    e = e.withColumn("points", F.transform("ps", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))).withColumn("diameters", F.transform("ps", lambda p: 2 * p["r"]))
    turn = oriented(F.col("points"), F.col("source"))
    e = e.withColumn("turn", turn).withColumns({c: F.when(F.col("turn"), F.reverse(c)).otherwise(F.col(c)) for c in ("points", "diameters")})
    e = e.withColumn("lengths2", segments(F.col("points")))
    return v, e.select(F.lit(graph).alias("graph"), "eid", "src", "dst", "nkind", total(F.col("lengths2")).alias("length"), finite_max(F.col("diameters")).alias("diameter"), "points", "diameters", "lengths2", per_point(F.col("lengths2")).alias("lengths"), tortuosity(F.col("points")).alias("tortuosity"))


def ranges(edges: DataFrame, width: int = 100_000) -> DataFrame:
    """(eid, start, end): edges numbered from 0 in the order of their ids, and the range of their points among all.

    Running sums are taken within buckets of ids and over the buckets, so that no task sorts all edges. Edges are shuffled by
    bucket in any case, so they are merged with the buckets' sums: files of sorted numbers say nothing about the size of their rows.
    """
    e = materialize(edges.select("eid", F.size("points").cast("long").alias("n"), F.floor(F.col("eid") / width).alias("bucket")), "sizes")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = e.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("s")).select("bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in "ms"))
    inside = Window.partitionBy("bucket").orderBy("eid")
    e = e.withColumn("at", F.row_number().over(inside) - 1).withColumn("upto", F.sum("n").over(inside)).hint("merge").join(base, "bucket")
    return e.select(F.col("eid").alias("old_eid"), (F.col("m") + F.col("at")).alias("eid"), (F.col("s") + F.col("upto") - F.col("n")).alias("start"), (F.col("s") + F.col("upto")).alias("end"))


def save(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    """A network of one graph as the files that ``load`` reads; vertices have a ``radius``."""
    by_vertex = {"vertices": ["vid"], "coordinates": ["x", "y", "z"], "radii": ["radius"], "annotation": ["annotation"], "distance_to_surface": ["distance_to_surface"]}
    save_columns(vertices, folder, {f"{n}.csv": c for n, c in by_vertex.items()}, "vid")
    numbered = materialize(ranges(edges), "ranges")
    e = edges.withColumnRenamed("eid", "old_eid").join(numbered, "old_eid").withColumns({n: (F.col("nkind") == k).cast("int") for k, n in ((2, "artery"), (3, "vein"))})
    e = materialize(e.select("eid", "src", "dst", "artery", "vein", "start", "end", "points", "diameters"), "bundle")
    save_columns(e, folder, {"edges.csv": ["src", "dst"], "artery.csv": ["artery"], "vein.csv": ["vein"], "edge_geometry_indices.csv": ["start", "end"]}, "eid")
    points = e.select("start", F.posexplode("points").alias("i", "p"), "diameters").select((F.col("start") + F.col("i")).alias("at"), "p.*", (F.get("diameters", F.col("i")) / 2).alias("r"))
    save_columns(points, folder, {"edge_geometry_coordinates.csv": ["x", "y", "z"], "edge_geometry_radii.csv": ["r"]}, "at")


def save_columns(df: DataFrame, folder: str, files: dict[str, list[str]], order: str) -> None:
    """Each group of columns in a folder of headerless CSV files, by the order of a column over its part files."""
    require_columns(df, [order, *(c for cs in files.values() for c in cs)])
    columns.write(df, folder, files, order)


def save_table(df: DataFrame, path: str) -> bool:
    """A CSV folder with a header; nothing for an empty table."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").csv(path, header=True)
    return True


def save_network(vertices: DataFrame, edges: DataFrame, folder: str, meta: dict[str, str] | None = None) -> None:
    """Parquet tables by graph, and a row of metadata with sizes and column names.

    Rows are brought together by graph first, or each task would write a file for each of its graphs; large graphs are split over tasks.
    """
    vertices.hint("rebalance", "graph").write.mode("overwrite").partitionBy("graph").parquet(f"{folder}/vertices")
    edges.hint("rebalance", "graph").write.mode("overwrite").partitionBy("graph").parquet(f"{folder}/edges")
    size = vertices.groupBy("graph").agg(F.count("*").alias("n_vertices")).join(edges.groupBy("graph").agg(F.count("*").alias("n_edges")), "graph", "left")
    extra = {k: F.lit(v) for k, v in (meta or {}).items()} | {"vertex_columns": F.lit(",".join(vertices.columns)), "edge_columns": F.lit(",".join(edges.columns))}
    size.withColumns(extra).write.mode("overwrite").parquet(f"{folder}/graph_meta")


def load_network(spark: SparkSession, folder: str, graph: str | None = None) -> tuple[DataFrame, DataFrame]:
    v, e = spark.read.parquet(f"{folder}/vertices"), spark.read.parquet(f"{folder}/edges")
    return (v, e) if graph is None else (v.where(F.col("graph") == graph), e.where(F.col("graph") == graph))


def convert_network(spark: SparkSession, folder: str, factors: tuple[float, float, float]) -> str:
    """A saved network in micrometres beside it: the folder's name with _um, which is not put there twice."""
    out = folder.rstrip("/") if folder.rstrip("/").endswith("_um") else f"{folder.rstrip('/')}_um"
    v, e = to_um(*load_network(spark, folder), factors)
    if out == folder.rstrip("/"):  # what is read can't be written over
        v, e = materialize(v, "converted"), materialize(e, "converted")
    save_network(v, e, out, {"space": "um"})
    return out


def load_regions(spark: SparkSession, path: str) -> DataFrame:
    """(id, parent_id, name) of an ontology's CSV file with a header."""
    return spark.read.csv(path, header=True).select(F.col("id").cast("long").alias("id"), F.col("parent_id").try_cast("long").alias("parent_id"), "name")


def load_region_tree(spark: SparkSession, path: str, most: int = 40) -> DataFrame:
    """(id, parent_id, name, acronym) of an ontology's JSON trees, {"msg": [{id, name, acronym, children: [...]}]}.

    Levels are unnested one a round, at most ``most``.
    """
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("j"))
    level = text.select(F.explode(F.expr("CAST(variant_get(j, '$.msg') AS ARRAY<VARIANT>)")).alias("n"), F.lit(None).cast("long").alias("parent_id"))
    out = None
    for _ in range(most):
        get = lambda k, t: F.try_variant_get("n", f"$.{k}", t)
        rows_ = level.select(get("id", "long").alias("id"), "parent_id", get("name", "string").alias("name"), get("acronym", "string").alias("acronym"))
        out = rows_ if out is None else out.unionByName(rows_)
        level = level.select(F.explode(F.expr("CAST(try_variant_get(n, '$.children') AS ARRAY<VARIANT>)")).alias("c"), get("id", "long").alias("parent_id")).select(F.col("c").alias("n"), "parent_id")
        if level.isEmpty():
            return out
    raise ValueError(f"the tree has more than {most} levels")


def load_results(spark: SparkSession, folders: dict[str, str], key: str) -> DataFrame:
    """The CSV tables of several regions, named {region}_{key}, one below the other with ``region``."""
    parts = [spark.read.csv(f"{folder}/{region}_{key}", header=True, inferSchema=True).withColumn("region", F.lit(region)) for region, folder in folders.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
