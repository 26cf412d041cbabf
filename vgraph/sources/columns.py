"""Headerless CSV files whose row order is the key: several files read side by side by ranges of rows, and written so in one sort.

Reading counts the rows of byte ranges first, all ranges at once; then a task for each range of rows takes its lines out of every
file. Nothing is written or shuffled, the row number comes with the rows, and no size is claimed that would send them to the driver. Writing sorts once; each task writes its part of all
files into a folder of its own, and the driver moves the parts of the tasks that were committed.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import csv, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a range that is counted, and of the longest file that a task reads.
COUNTED, READ = 32 << 20, 16 << 20


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder and the path in it; a plain path is a local one."""
    found, path = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{os.path.abspath(folder)}")
    return found, path.rstrip("/")


def _parts(folder: str, name: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the part files in order where it is a folder."""
    store, path = place(folder)
    found = store.get_file_info(f"{path}/{name}.csv")
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{folder}/{name}.csv")
    files = [found] if found.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(found.path)) if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.base_name)
    return [(f.path, f.size) for f in files if f.size]


def _count(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = place(folder)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with store.open_input_file(r["path"]) as f:
                    data = np.frombuffer(f.read_at(r["length"], r["start"]), np.uint8)
                # a last line may have no end
                rows.append(int((data == 10).sum()) + int(r["last"] and data[-1] != 10))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(rows, pa.int64())], ["k", "n"])

    return run


def _each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """One task for each row; the first column numbers them."""
    return spark.createDataFrame(rows, schema).repartitionByRange(max(len(rows), 1), "k")


def _lines(store: fs.FileSystem, ranges: list[dict], first: int, last: int) -> bytes:
    """The bytes of lines first to last, of ranges (path, start, length, row, n) that hold them."""
    out = []
    for r in ranges:
        with store.open_input_file(r["path"]) as f:
            data = f.read_at(r["length"], r["start"])
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        # line i of the range begins behind the end of line i - 1; line 0 may have begun in the range before
        a, b = max(first - r["row"], 0), min(last - r["row"], r["n"])
        begin = 0 if first <= r["row"] else int(ends[a - 1]) + 1
        stop = int(ends[b - 1]) + 1 if last <= r["row"] + len(ends) and b > 0 else len(data) if last > r["row"] else 0
        out.append(data[begin:stop])
    return b"".join(out)


@dataclass
class _Rows(InputPartition):
    first: int
    last: int
    ranges: dict[str, list[dict]]


class _Reader(DataSourceReader):
    """One task for each range of rows."""

    def __init__(self, folder: str, files: dict[str, list[str]], tasks: list[list]):
        self.folder, self.files, self.tasks = folder, files, tasks

    def partitions(self) -> list[InputPartition]:
        return [_Rows(*t) for t in self.tasks]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        store, _ = place(self.folder)
        first, last, columns = partition.first, partition.last, {}
        for name, names in self.files.items():
            data = _lines(store, partition.ranges[name], first, last)
            kinds = dict.fromkeys(names, pa.float64())
            options = csv.ConvertOptions(column_types=kinds, strings_can_be_null=True)
            table = csv.read_csv(io.BytesIO(data), csv.ReadOptions(column_names=names, use_threads=False), csv.ParseOptions(ignore_empty_lines=False), options)
            if table.num_rows != last - first:
                raise ValueError(f"{self.folder}/{name}.csv: {table.num_rows} rows read from {first} to {last}")
            columns |= {c: table.column(c).combine_chunks() for c in names}
        yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(first, last)), **columns})


def read(spark: SparkSession, folder: str, files: dict[str, list[str]]) -> DataFrame:
    """(row, columns as doubles) of files of as many rows each, {name: columns}; ``row`` counts from 0 in the files' order.

    A file may be a folder of part files. Files of different lengths raise an error. The driver holds a few numbers for each
    ``COUNTED`` bytes.
    """
    ranges = []
    for name in files:
        for path, size in _parts(folder, name):
            for start in range(0, size, COUNTED):
                length = min(COUNTED, size - start)
                ranges.append({"name": name, "path": path, "start": start, "length": length, "last": start + length == size})
    schema = "row long, " + ", ".join(f"{c} double" for names in files.values() for c in names)
    if not ranges:
        return spark.createDataFrame([], schema)
    asked = _each(spark, [(k, r["path"], r["start"], r["length"], r["last"]) for k, r in enumerate(ranges)], "k long, path string, start long, length long, last boolean")
    for k, n in asked.mapInArrow(_count(folder), "k long, n long").collect():
        ranges[k]["n"] = n
    of = {name: [r for r in ranges if r["name"] == name] for name in files}
    for rows in of.values():
        row = 0
        for r in rows:
            r["row"] = row
            row += r["n"]
    totals = {name: sum(r["n"] for r in rows) for name, rows in of.items()}
    total = max(totals.values())
    if min(totals.values()) != total:
        raise ValueError(f"files of different lengths in {folder}: {totals}")
    longest = max(sum(r["length"] for r in rows) for rows in of.values())
    step = max(1, -(-total // (longest // READ + 1)))
    tasks = []
    for first in range(0, total, step):
        last = min(first + step, total)
        # a line may run over the end of a range, so the range behind is read for its first line's beginning
        need = {name: [{c: r[c] for c in ("path", "start", "length", "row", "n")} for r in rows if r["row"] <= last and r["row"] + r["n"] >= first] for name, rows in of.items()}
        tasks.append((first, last, need))
    spark.dataSource.register(ColumnFiles)
    return spark.read.format("column_files").schema(schema).option("files", json.dumps(files)).option("tasks", json.dumps(tasks)).load(folder)


@dataclass
class _Part(WriterCommitMessage):
    names: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, files: dict[str, list[str]]):
        self.folder, self.files, self.job = folder, files, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        store, path = place(self.folder)
        task = TaskContext.get()
        own = f"{path}/_temporary-{self.job}/{task.partitionId():05d}-{task.taskAttemptId()}"
        out, names = {}, []
        for batch in iterator:
            if batch.num_rows:
                for name, columns in self.files.items():
                    if name not in out:
                        store.create_dir(own, recursive=True)
                        out[name] = store.open_output_stream(f"{own}/{name}")
                        names.append((f"{own}/{name}", f"{name}/part-{task.partitionId():05d}.csv"))
                    csv.write_csv(batch.select(columns), out[name], csv.WriteOptions(include_header=False))
        for f in out.values():
            f.close()
        return _Part(names)

    def commit(self, messages: list) -> None:
        store, path = place(self.folder)
        for name in self.files:
            store.create_dir(f"{path}/{name}", recursive=True)
            store.delete_dir_contents(f"{path}/{name}")
        for m in messages:
            for old, new in m.names if m is not None else []:
                store.move(old, f"{path}/{new}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, path = place(self.folder)
        store.delete_dir_contents(f"{path}/_temporary-{self.job}", missing_dir_ok=True)
        if store.get_file_info(f"{path}/_temporary-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_temporary-{self.job}")


class ColumnFiles(DataSource):
    """Groups of columns (option ``files``, as JSON) in CSV files side by side: written, or read by ranges of rows (option ``tasks``)."""

    @classmethod
    def name(cls) -> str:
        return "column_files"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], json.loads(self.options["files"]), json.loads(self.options["tasks"]))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], json.loads(self.options["files"]))


def write(df: DataFrame, folder: str, files: dict[str, list[str]], order: str) -> None:
    """Each group of columns as a folder of headerless CSV parts, {name: columns}, all in the order of one column: one sort, one pass."""
    df.sparkSession.dataSource.register(ColumnFiles)
    needed = list(dict.fromkeys(c for columns in files.values() for c in columns))
    # without a number the ranges follow the size of what is shuffled
    dealt = df.select(order, *(c for c in needed if c != order)).repartitionByRange(order).sortWithinPartitions(order)
    dealt.select(needed).write.format("column_files").option("files", json.dumps(files)).mode("append").save(folder)
