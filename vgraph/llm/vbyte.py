"""Token ids in byte-aligned variable-length coding with separate control bytes.

Ids are ranked by their frequency in the corpus, so that the 256 most frequent
take one byte. A file is a Parquet folder of blocks in ascending doc_id order. A
block's payload has a header, the documents' ids and lengths, a control byte for each four
ranks (two bits each: its bytes less one) and the ranks' bytes. Blocks are decoded by
table lookup: a control byte gives four lengths, their running sum the places.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vgraph.llm.arrays import lean
from vgraph.llm.tokens import default_vocabulary, width, with_ids
from vgraph.plans.workspace import materialize, work_dir

MAGIC = b"FRVB\x01\x00\x00\x00"
#: Ids in a block, but for a longer document, and bytes of packed ids in a partition.
BLOCK, PART_BYTES = 1 << 18, 16 << 20
#: For each control byte the lengths of its four ranks.
LENGTHS = np.stack([(np.arange(256) >> 2 * j & 3) + 1 for j in range(4)], 1)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    used = np.arange(4) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks."""
    size = LENGTHS[control].ravel()[:n]
    first = np.cumsum(size) - size
    data = np.append(data, np.zeros(3, np.uint8))
    out = data[first].astype(np.uint32)
    for j in (1, 2, 3):
        long = np.flatnonzero(size > j)
        out[long] |= data[first[long] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def payload(docs: np.ndarray, known: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode(ranks)
    head = np.array([len(docs), len(ranks), len(control), len(data)], "<i8")
    return b"".join([MAGIC, head.tobytes(), docs.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), counts.astype("<i8").tobytes(), control, data])


def read_payload(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, whether they are known, lengths, ranks) of a block."""
    if raw[:8] != MAGIC:
        raise ValueError("not a block of this format")
    n, total, n_control, n_data = (int(x) for x in np.frombuffer(raw, "<i8", 4, 8))
    at = 40
    docs = np.frombuffer(raw, "<i8", n, at)
    known = np.frombuffer(raw, np.uint8, n, at + 8 * n).astype(bool)
    counts = np.frombuffer(raw, "<i8", n, at + 9 * n)
    at += 17 * n
    return docs, known, counts, decode(np.frombuffer(raw, np.uint8, n_control, at), np.frombuffer(raw, np.uint8, n_data, at + n_control), total)


@lean
def _histogram(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        counts = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
        if len(counts) > len(total):
            total = np.pad(total, (0, len(counts) - len(total)))
        total[: len(counts)] += counts
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(found), "n": pa.array(total[found])})


def write_ids(docs: DataFrame, folder: str, path: str | None = None) -> str:
    """Write the ids of all texts to ``folder``, in ascending doc_id order (nulls first; rows of one doc_id by a hash of their ids).

    Subfolders: blocks (part, block, n_docs, n_tokens, payload) and ranks (rank, id).
    """
    spark = docs.sparkSession
    path = path or default_vocabulary()
    kind = width(path)
    tokens = materialize(with_ids(docs, path, kind), "tokens")
    # one row for each id of the vocabulary at most
    counts = tokens.mapInArrow(lambda batches: _histogram(batches, kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    order = np.array([r[0] for r in counts.orderBy(F.desc("n"), "id").collect()], np.int64)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order))
    sent = spark.sparkContext.broadcast(rank)
    size = int(tokens.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, n = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            docs = np.array([0 if d is None else d for d, _ in held], np.int64)
            known = np.array([d is not None for d, _ in held])
            counts = np.array([len(x) for _, x in held])
            body = payload(docs, known, counts, sent.value[np.concatenate([x for _, x in held])])
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "block": pa.array([block], pa.int64()), "n_docs": pa.array([len(held)], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "payload": pa.array([body], pa.binary())})

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind)
                if held and n + len(ids) > BLOCK:
                    yield out()
                    block, held, n = block + 1, [], 0
                held.append((doc, ids))
                n += len(ids)
        if held:
            yield out()

    # rows that share a doc_id are told apart by a hash, so that many of them aren't one range
    hashed = tokens.withColumn("hash", F.xxhash64("ids"))
    ordered = hashed.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").drop("hash")
    blocks = ordered.mapInArrow(run, "part long, block long, n_docs long, n_tokens long, payload binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_ids(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, with ``ids``, ids) of each document of a written folder."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    sent = spark.sparkContext.broadcast(np.array([r[0] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").collect()], "<u4"))
    # running sums within parts, and over the one row of each part (some 16 MB of ids)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.unboundedPreceding, -1
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(*before)
    places = blocks.select("part", "block", "n_tokens").withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    places = places.join(parts, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("first"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column("first").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                docs, known, counts, ranks = read_payload(raw)
                found = sent.value[ranks]
                ends = np.cumsum(counts)
                parts = [found[b - n : b].tobytes() for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = {"doc_id": pa.array(docs, mask=~known), "start": pa.array(first + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64())}
                if ids:
                    columns["ids"] = pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return blocks.join(places, ["part", "block"]).select("first", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def new_folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/ids-{uuid.uuid4().hex}"
