"""Polylines as VTK PolyData in XML: one document for each task, with a piece for each batch of lines, and a parallel index over them.

Arrays are compressed and written as base64, which VTK reads as it does plain text: values stay exact and take a fraction of the bytes.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from vgraph.functions import stats
from vgraph.functions.geometry import distance
from vgraph.plans.workspace import materialize
from vgraph.schema import CAPILLARY
from vgraph.sources.columns import place

#: The index's name, and how far apart two points are that are not one.
INDEX, APART = "index.pvtp", 1e-8


def lines(vertices: DataFrame, edges: DataFrame, apart: float = APART) -> DataFrame:
    """(graph, eid, nkind, length, diameter, points): drawable edges.

    Loops and edges whose ends coincide go, consecutive equal points are merged, missing values become -1000, -1 and 0.
    """
    e = edges.where("src <> dst and size(points) > 1").where(distance(F.element_at("points", 1), F.element_at("points", -1)) >= apart)
    keep = F.filter("points", lambda p, i: (i == 0) | (distance(p, F.get("points", F.greatest(i - 1, F.lit(0)))) > 0))
    return e.select("graph", "eid", F.coalesce("nkind", F.lit(-1)).alias("nkind"), F.coalesce("length", F.lit(-1000.0)).alias("length"), F.coalesce("diameter", F.lit(0.0)).alias("diameter"), keep.alias("points"))


def path_lines(paths: DataFrame, vertices: DataFrame) -> DataFrame:
    """(graph, eid, points) of vertex paths; ``eid`` is the path's source."""
    p = paths.select("graph", F.col("source").alias("eid"), F.posexplode("path").alias("at", "vid")).join(vertices.select("graph", "vid", "x", "y", "z"), ["graph", "vid"])
    pts = F.transform(F.array_sort(F.collect_list(F.struct("at", "x", "y", "z"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z")))
    return p.groupBy("graph", "eid").agg(pts.alias("points"), F.lit(CAPILLARY).alias("nkind"), F.lit(0.0).alias("length"), F.lit(0.0).alias("diameter"))


def labelled_lines(vertices: DataFrame, edges: DataFrame, trees: DataFrame, major: bool = False) -> DataFrame:
    """Straight segments of labelled edges (graph, eid, component, is_major, major_tree_id) with their class, labels, length and diameter.

    ``major`` keeps the edges of major trees only; a missing number is -1.
    """
    t = trees.where("is_major") if major else trees
    drawn = chosen_lines(vertices, edges, t)
    t = t.select("graph", "eid", "component", F.col("is_major").cast("int").alias("is_major"), F.coalesce("major_tree_id", F.lit(-1)).alias("major_tree_id"))
    return drawn.join(t, ["graph", "eid"]).select("graph", "eid", "nkind", "component", "is_major", "major_tree_id", "length", "diameter", "points")


def chosen_lines(vertices: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Straight segments of the chosen edges (graph, eid)."""
    at = lambda side: vertices.select("graph", F.col("vid").alias(side), F.struct("x", "y", "z").alias(f"{side}_p"))
    e = edges.join(ids.select("graph", "eid").distinct(), ["graph", "eid"], "left_semi").join(at("src"), ["graph", "src"]).join(at("dst"), ["graph", "dst"])
    return e.select("graph", "eid", "nkind", "length", "diameter", F.array("src_p", "dst_p").alias("points"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``nth``, their places from 0 in their graph in the order of a key that stands once there; ``rows`` should be a table.

    Rows are sorted by ranges of graphs and keys and written once with their place in the range. A graph's places begin
    at its first row of a range, behind its rows of the ranges before.
    """
    ranges = rows.count() // stats.RANGE + 1
    dealt = rows.repartitionByRange(ranges, "graph", key).sortWithinPartitions("graph", key).withColumn("__at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("__range", F.shiftright("__at", 33)), "dealt")
    before = Window.partitionBy("graph").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("graph", "__range").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    # written, as a table of known size is sent to the rows where it is small; unknown, all rows would be shuffled for it
    starts = materialize(starts.select("graph", "__range", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start")), "starts")
    return dealt.join(starts, ["graph", "__range"]).select(*rows.columns, (F.col("__at") - F.col("start")).alias("nth"))


def network_lines(vertices: DataFrame, edges: DataFrame, tortuous: bool = True) -> DataFrame:
    """(graph, eid, points, cells): each drawable edge with the values of its points and of the cells between them.

    Loops go, as do edges whose vertices coincide; vertices are numbered from 0 among those that are left with an edge, and so are edges. Points
    have ``index`` and, where the vertices have these columns, ``pBC`` (missing: -1000) and ``pressure`` (missing: 0). Straight edges
    have one cell with diameter, length (missing: 0) and nkind (missing: -1). Tortuous ones have a cell for every two points in a row, and
    inner points with fractional indices, no pBC and a pressure between the vertices'. Equal points in a row are merged, and
    points run from ``src`` to ``dst``; diameters and lengths2 keep their order, and are 0 where their number doesn't fit.
    """
    named = [c for c in ("pBC", "pressure") if c in vertices.columns]
    v = vertices.select("graph", "vid", F.struct("x", "y", "z").alias("at"), *named)
    ends = lambda of, side, *columns: of.select("graph", F.col("vid").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))
    # ids alone go through the joins by vertex and get their numbers; what an edge carries is shuffled once, to the numbered ids
    ids = edges.where("src <> dst").select("graph", "eid", "src", "dst")
    ids = ids.join(ends(v, "src", "at"), ["graph", "src"]).join(ends(v, "dst", "at"), ["graph", "dst"]).where(distance(F.col("src_at"), F.col("dst_at")) >= APART)
    ids = materialize(ids.select("graph", "eid", "src", "dst").distinct(), "drawn")
    v = v.join(numbered(materialize(ids.select("graph", F.explode(F.array("src", "dst")).alias("vid")).distinct(), "ends"), "vid"), ["graph", "vid"])
    v = v.withColumn("nth", F.col("nth").cast("double"))
    if tortuous:
        ids = numbered(ids, "eid").withColumnRenamed("nth", "edge")
    for side in ("src", "dst"):
        ids = ids.join(ends(v, side, "at", "nth", *named), ["graph", side])
    carried = ["nkind", "length", "diameter", *(["points", "diameters", "lengths2"] if tortuous else [])]
    e = edges.select("graph", "eid", "src", "dst", *carried).join(ids, ["graph", "eid", "src", "dst"])
    number = lambda c, missing: F.coalesce(F.col(c).cast("double"), F.lit(float(missing)))
    point = lambda at, index, pbc, pressure: F.struct(*(at[a].alias(a) for a in "xyz"), index.alias("index"), *(x.alias(c) for c, x in (("pBC", pbc), ("pressure", pressure)) if c in named))
    end = lambda side: point(F.col(f"{side}_at"), F.col(f"{side}_nth"), number(f"{side}_pBC", -1000) if "pBC" in named else F.lit(0.0), number(f"{side}_pressure", 0) if "pressure" in named else F.lit(0.0))
    if not tortuous:
        cell = F.struct(number("diameter", 0).alias("diameter"), number("length", 0).alias("length"), number("nkind", -1).alias("nkind"))
        return e.select("graph", "eid", F.array(end("src"), end("dst")).alias("points"), F.array(cell).alias("cells"))
    p = F.col("points")
    e = e.withColumn("points", F.filter(p, lambda x, i: (i == 0) | (distance(x, F.get(p, F.greatest(i - 1, F.lit(0)))) > APART)))
    e = e.withColumn("points", F.when(F.size(p) < 2, F.array("src_at", "dst_at")).otherwise(p))
    e = e.withColumn("points", F.when(distance(F.col("src_at"), p[0]) > distance(F.col("src_at"), F.element_at(p, -1)), F.reverse(p)).otherwise(p))
    n = F.size(p)
    e = e.withColumn("step", F.when(n >= 10, 0.001).otherwise(0.1))
    between = lambda i: number("src_pressure", 0) + i * ((number("dst_pressure", 0) - number("src_pressure", 0)) / (n - 1.0)) if "pressure" in named else F.lit(0.0)
    # the first and the last point are the vertices themselves
    inner = F.transform(F.slice(p, F.lit(2), n - 2), lambda x, i: point(x, F.col("edge") + (i + 1) * F.col("step"), F.lit(-1000.0), between(i + 1)))
    fit = lambda c, least: F.size(c) == n - least
    value = lambda c, i: F.coalesce(F.get(F.col(c), i), F.lit(0.0))
    cells = F.transform(
        F.sequence(F.lit(0), n - 2),
        lambda i: F.struct(
            (F.col("edge") + i * F.col("step")).alias("index"),
            (number("diameter", 0) / 2).alias("radius"),
            number("diameter", 0).alias("vessel_diameter"),
            number("length", 0).alias("vessel_length"),
            number("nkind", -1).alias("vessel_nkind"),
            F.when(fit("lengths2", 1), value("lengths2", i)).otherwise(0.0).alias("lengths2"),
            F.when(fit("diameters", 0), (value("diameters", i) + value("diameters", i + 1)) / 2).otherwise(0.0).alias("diameters"),
        ),
    )
    return e.select("graph", "eid", F.concat(F.array(end("src")), inner, F.array(end("dst"))).alias("points"), cells.alias("cells"))


def _array(name: str, values: np.ndarray, components: int = 1) -> str:
    kind = "Int64" if values.dtype == np.int64 else "Float64"
    return f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{components}" format="binary">\n{_packed(values)}\n</DataArray>\n'


def _packed(values: np.ndarray) -> str:
    """Values as one compressed block: base64 of the numbers of blocks and bytes, then of the block."""
    raw = values.astype("<i8" if values.dtype == np.int64 else "<f8").tobytes()
    block = zlib.compress(raw, 1) if raw else b""
    head = np.array([1, len(raw), 0, len(block)] if raw else [0, 0, 0], "<u8")
    return (base64.b64encode(head.tobytes()) + base64.b64encode(block)).decode()


def _values(array: ElementTree.Element, kind: str) -> np.ndarray:
    """The values of an array, compressed or in plain text."""
    text = (array.text or "").strip()
    if array.get("format") == "ascii":
        return np.array(text.split(), kind)
    blocks = int(np.frombuffer(base64.b64decode(text[:12])[:8], "<u8")[0])
    # three numbers and one for each block, in groups of three bytes
    end = -(-8 * (3 + blocks) // 3) * 4
    sizes = np.frombuffer(base64.b64decode(text[:end]), "<u8")[3:].tolist()
    data, raw = base64.b64decode(text[end:]), []
    for size in sizes:
        raw.append(zlib.decompress(data[:size]))
        data = data[size:]
    return np.frombuffer(b"".join(raw), kind)


def _piece(batch: pa.RecordBatch) -> tuple[str, int, int]:
    """The text of a batch of lines, and its numbers of points and cells."""
    points, cells = batch.column("points"), batch.column("cells")
    n_points, n_cells = (pc.list_value_length(x).to_numpy() for x in (points, cells))
    p, c = points.flatten(), cells.flatten()
    field = lambda x, name: pc.struct_field(x, name).cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.cumsum(n_points) - n_points
    # one cell runs through all points of its line, several have two points each
    size = np.where(n_cells == 1, n_points, 2)
    if ((n_cells != 1) & (n_cells != n_points - 1)).any():
        raise ValueError("a line has one cell, or one between every two points in a row")
    sizes = np.repeat(size, n_cells)
    start = np.repeat(first, n_cells) + np.arange(n_cells.sum()) - np.repeat(np.cumsum(n_cells) - n_cells, n_cells)
    ends = np.cumsum(sizes)
    ids = np.repeat(start - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    names = lambda x: [f.name for f in x.type if f.name not in ("x", "y", "z")]
    xyz = np.stack([field(p, a) for a in "xyz"], 1).ravel()
    text = (
        f'<Piece NumberOfPoints="{len(p)}" NumberOfVerts="0" NumberOfLines="{len(c)}" NumberOfStrips="0" NumberOfPolys="0">\n'
        f"<PointData>\n{''.join(_array(k, field(p, k)) for k in names(p))}</PointData>\n<CellData>\n{''.join(_array(k, field(c, k)) for k in names(c))}</CellData>\n"
        f"<Points>\n{_array('Points', xyz, 3)}</Points>\n<Lines>\n{_array('connectivity', ids.astype(np.int64))}{_array('offsets', ends.astype(np.int64))}</Lines>\n</Piece>\n"
    )
    return text, len(p), len(c)


@dataclass
class _Part(WriterCommitMessage):
    name: str | None
    points: int = 0
    cells: int = 0


class _Writer(DataSourceArrowWriter):
    """Each task writes a document of its own; the driver writes the parallel index of those that were committed."""

    def __init__(self, folder: str, schema: StructType, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.fields = [[f.name for f in schema[c].dataType.elementType.fields if f.name not in ("x", "y", "z")] for c in ("points", "cells")]
        if overwrite:
            store, path = place(folder)
            for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.base_name == INDEX or (f.base_name.startswith("part-") and f.extension == "vtp"):
                    store.delete_file(f.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        store, path = place(self.folder)
        name, points, cells, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.vtp", 0, 0, None
        for batch in iterator:
            if batch.num_rows:
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}")
                    out.write(b'<?xml version="1.0"?>\n<VTKFile type="PolyData" version="1.0" byte_order="LittleEndian" header_type="UInt64" compressor="vtkZLibDataCompressor">\n<PolyData>\n')
                text, n, m = _piece(batch)
                out.write(text.encode())
                points, cells = points + n, cells + m
        if out is None:
            return _Part(None)
        out.write(b"</PolyData>\n</VTKFile>\n")
        out.close()
        return _Part(name, points, cells)

    def commit(self, messages: list) -> None:
        store, path = place(self.folder)
        store.create_dir(path, recursive=True)
        parts = sorted(m.name for m in messages if m is not None and m.name)
        arrays = lambda kind, names: f"<{kind}>\n{''.join(f'<PDataArray type=\"Float64\" Name=\"{k}\"/>\n' for k in names)}</{kind}>\n"
        text = (
            '<?xml version="1.0"?>\n<VTKFile type="PPolyData" version="1.0" byte_order="LittleEndian" header_type="UInt64" compressor="vtkZLibDataCompressor">\n<PPolyData GhostLevel="0">\n'
            + arrays("PPointData", self.fields[0])
            + arrays("PCellData", self.fields[1])
            + '<PPoints>\n<PDataArray type="Float64" NumberOfComponents="3"/>\n</PPoints>\n'
            + "".join(f'<Piece Source="{name}"/>\n' for name in parts)
            + "</PPolyData>\n</VTKFile>\n"
        )
        with store.open_output_stream(f"{path}/{INDEX}") as out:
            out.write(text.encode())

    def abort(self, messages: list) -> None:
        store, path = place(self.folder)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{path}/{m.name}")


@dataclass
class _Document(InputPartition):
    name: str


class _Reader(DataSourceReader):
    """One task for each document of the index."""

    def __init__(self, folder: str, what: str, schema: StructType):
        self.folder, self.what = folder, what
        self.names = [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [_Document(p.get("Source")) for p in _index(self.folder).iter("Piece")]

    def read(self, partition: _Document) -> Iterator[pa.RecordBatch]:
        store, path = place(self.folder)
        with store.open_input_file(f"{path}/{partition.name}") as f:
            for k, (_, piece) in enumerate(x for x in ElementTree.iterparse(f, events=("end",)) if x[1].tag == "Piece"):
                numbers = lambda where, name, kind="<f8": _values(piece.find(f"{where}/DataArray[@Name='{name}']"), kind)  # noqa: E731, B023
                xyz = numbers("Points", "Points").reshape(-1, 3)
                if self.what == "points":
                    own = dict(zip("xyz", xyz.T, strict=True)) | {"nth": np.arange(len(xyz))}
                else:
                    ids, ends = numbers("Lines", "connectivity", "<i8"), numbers("Lines", "offsets", "<i8")
                    starts = np.append(0, ends[:-1]).astype(int)
                    own = {"nth": np.arange(len(ends)), "n_points": ends - starts} | {f"{a}{end}": xyz[ids[at], j] for end, at in (("1", starts), ("2", ends - 1)) for j, a in enumerate("xyz")}
                own |= {"document": [partition.name] * len(own["nth"]), "piece": np.full(len(own["nth"]), k)}
                data = "PointData" if self.what == "points" else "CellData"
                yield pa.RecordBatch.from_pydict({n: own[n] if n in own else numbers(data, n) for n in self.names})
                piece.clear()


def _index(folder: str) -> ElementTree.Element:
    store, path = place(folder)
    with store.open_input_file(f"{path}/{INDEX}") as f:
        return ElementTree.parse(f).getroot()


class VtpSource(DataSource):
    """Lines (points, cells) as VTK PolyData: a document a task and a parallel index; read back as points or cells (option ``part``)."""

    @classmethod
    def name(cls) -> str:
        return "vtp"

    def schema(self) -> str:
        what = self.options.get("part", "cells")
        own = "x double, y double, z double" if what == "points" else "n_points long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"
        tag = "PPointData" if what == "points" else "PCellData"
        values = "".join(f", `{a.get('Name')}` double" for a in _index(self.options["path"]).findall(f".//{tag}/PDataArray"))
        return f"document string, piece long, nth long, {own}{values}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("part", "cells"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


def write(drawn: DataFrame, folder: str) -> None:
    """A folder of VTP documents and their index. Numeric columns beside ``points`` become values of one cell a line, unless there are ``cells``."""
    drawn.sparkSession.dataSource.register(VtpSource)
    if "cells" not in drawn.columns:
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in drawn.columns if c not in ("graph", "points")]
        drawn = drawn.withColumn("cells", F.array(F.struct(*numbers)))
    drawn.select("points", "cells").write.format("vtp").mode("overwrite").save(folder)


def read(spark: SparkSession, folder: str, part: str = "cells") -> DataFrame:
    """The points or the cells of a folder of VTP documents with their values; cells with the coordinates of their ends."""
    spark.dataSource.register(VtpSource)
    return spark.read.format("vtp").option("part", part).load(folder)
