"""Variables of MAT files of level 5 as rows, and the voxel graphs in them.

A file is a header of 128 bytes and an element for each variable, most often compressed, so a task reads a variable. Structures,
cells, dense and sparse numbers are read; what else a file holds is left out. Level 7.3 is another format (HDF5) and is refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vgraph.sources import voxel_graph
from vgraph.sources.columns import place

SCHEMA = "name string, item long, start long, idx array<long>, values array<double>"
#: Numbers to a row, and rows to a batch.
CHUNK, BATCH = 100_000, 4096
#: Fixed values of the format: number types by their code, elements, and array classes.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, SPARSE = 1, 2, 5
NUMERIC = range(6, 16)


class _Elements:
    """Reads the elements of a buffer one after the other."""

    def __init__(self, data: memoryview, order: str):
        self.data, self.order, self.at = data, order, 0

    def __bool__(self) -> bool:
        return self.at + 8 <= len(self.data)

    def next(self) -> tuple[int, memoryview]:
        kind, size = struct.unpack_from(f"{self.order}II", self.data, self.at)
        if kind >> 16:  # a small element has its data in the tag
            size, kind = kind >> 16, kind & 0xFFFF
            body = self.data[self.at + 4 : self.at + 4 + size]
            self.at += 8
        else:
            body = self.data[self.at + 8 : self.at + 8 + size]
            self.at += 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)
        return kind, body

    def numbers(self) -> np.ndarray:
        kind, body = self.next()
        return np.frombuffer(body, np.dtype(NUMBERS[kind]).newbyteorder(self.order))


def _rows(data: memoryview, order: str, name: str | None = None, item: int = 0) -> Iterator[tuple]:
    """The rows of a matrix: (name, item, first place, places of a sparse one, numbers), places from 1 in the order of columns."""
    parts = _Elements(data, order)
    if not parts:
        return  # an empty cell
    kind = int(parts.numbers()[0]) & 0xFF
    dims = parts.numbers().astype(np.int64)
    own = bytes(parts.next()[1]).decode()
    name = name if name is not None else own
    if kind == CELL:
        for k in range(int(dims.prod())):
            yield from _rows(parts.next()[1], order, name, k + 1)
    elif kind == STRUCT:
        width = int(parts.numbers()[0])
        names = bytes(parts.next()[1])
        fields = [names[a : a + width].split(b"\0")[0].decode() for a in range(0, len(names), width)]
        for k in range(int(dims.prod())):
            for field in fields:
                yield from _rows(parts.next()[1], order, f"{name}.{field}", k + 1 if dims.prod() > 1 else item)
    elif kind == SPARSE:
        rows, starts = parts.numbers().astype(np.int64), parts.numbers().astype(np.int64)
        values = parts.numbers().astype(np.float64)[: starts[-1]]
        idx = rows[: len(values)] + 1 + dims[0] * np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for a in range(0, len(values), CHUNK):
            yield name, item, a + 1, idx[a : a + CHUNK], values[a : a + CHUNK]
    elif kind in NUMERIC:
        values = parts.numbers().astype(np.float64)
        for a in range(0, max(len(values), 1), CHUNK):
            yield name, item, a + 1, None, values[a : a + CHUNK]


@dataclass
class _Variable(InputPartition):
    start: int
    size: int
    order: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, path = place(self.path)
        with store.open_input_file(path) as f:
            head, end = f.read(128), f.size()
            order = {b"IM": "<", b"MI": ">"}.get(head[126:128])
            if order is None or struct.unpack(f"{order}H", head[124:126])[0] != 0x0100:
                raise ValueError(f"{self.path} is no MAT file of level 5")
            out, at = [], 128
            while at + 8 <= end:
                f.seek(at)
                kind, size = struct.unpack(f"{order}II", f.read(8))
                out.append(_Variable(at, size + 8, order))
                at += 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)
        return out

    def read(self, partition: _Variable) -> Iterator[pa.RecordBatch]:
        store, path = place(self.path)
        with store.open_input_file(path) as f:
            data = f.read_at(partition.size, partition.start)
        kind, body = _Elements(memoryview(data), partition.order).next()
        if kind == COMPRESSED:
            kind, body = _Elements(memoryview(zlib.decompress(body)), partition.order).next()
        rows: list[tuple] = []
        held = 0
        for row in _rows(body, partition.order) if kind == MATRIX else ():
            rows.append(row)
            held += len(row[4])
            if len(rows) >= BATCH or held >= 10 * CHUNK:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    name, item, start, idx, values = zip(*rows, strict=True)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((name, item, start, idx, values), kinds, strict=True)], names=["name", "item", "start", "idx", "values"])


class MatSource(DataSource):
    """(name, item, start, idx, values): the numbers of a MAT file of level 5, ``name`` with the fields of structures, ``item`` the cell."""

    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MatSource)
    return spark.read.format("mat").load(path)


def load(spark: SparkSession, path: str, graph: str, voxel: float = 1.0) -> tuple[DataFrame, DataFrame, tuple]:
    """(vertices, edges, mask size) of a voxel graph: the cells ``node.cc_ind`` and ``link.cc_ind``, the two ends of each link in
    ``link.connected_node_label`` (0: open), sparse radii and labels by voxel. Edges with an open end are dropped."""
    m = read(spark, path)
    of = lambda name: m.where(F.col("name") == name)
    mask = tuple(int(x) for x in of("num.mask_size").first()["values"])
    cells = lambda name, key: of(name).groupBy("item").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "values"))), lambda s: s["values"])).cast("array<bigint>").alias("cc")).withColumnRenamed("item", key)
    pairs = lambda name: of(name).select(F.explode(F.arrays_zip("idx", "values")).alias("p")).select(F.col("p.idx").alias("idx"), F.col("p.values").alias("value"))
    link_cc = cells("link.cc_ind", "link")
    # a matrix of two columns: the second begins behind as many numbers as there are links
    ends = of("link.connected_node_label").select("start", F.posexplode("values").alias("at", "label")).select((F.col("start") + F.col("at") - 1).alias("at"), F.col("label").cast("long").alias("label"))
    n = of("link.connected_node_label").agg((F.sum(F.size("values")) / 2).cast("long")).first()[0] or 0
    side = lambda k, name: ends.where((F.col("at") >= k * n) & (F.col("at") < (k + 1) * n)).select((F.col("at") - k * n + 1).alias("link"), F.col("label").alias(name))
    link_cc = link_cc.join(side(0, "src"), "link").join(side(1, "dst"), "link")
    vertices = voxel_graph.nodes(cells("node.cc_ind", "label"), pairs("radius"), mask, graph)
    edges = voxel_graph.links(link_cc, pairs("radius"), pairs("label"), mask, graph, voxel)
    return vertices, voxel_graph.closed(vertices, edges), mask
