"""Packing by shortest-pack-first over the histogram of lengths.

Documents are cut into pieces of at most the sequence length. The plan works on
the histogram alone: lengths are placed longest first, each into the shortest
packs so far, and only counts of packing patterns are kept. Where packs stay too empty,
the shortest ones are taken apart and their pieces cut to fill the others. Pieces find their places
by the rank that they have among the pieces of their length.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vgraph.llm.arrays import chunks, lean
from vgraph.llm.tokens import default_vocabulary, encoder, forget
from vgraph.plans.workspace import materialize

LENGTH = 4096
#: Pieces of one length that are ranked in a part.
PART = 200_000
#: A pack may stay empty by this part of its length before pieces are cut to fill it.
SLACK = 64


def plan(histogram: dict[int, int], most: int = LENGTH) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """[(packs, ((length, pieces in each pack), ...)), ...] for the numbers of pieces by length.

    Pieces that fit into no pack open packs of as many of them as fit. There are at
    most ``most`` lengths, and each placement uses up a length or a pattern, so the plan is small
    for any number of pieces.
    """
    heap: list[tuple[int, int, int, tuple]] = []
    serial = 0

    def push(total: int, packs: int, pattern: tuple) -> None:
        nonlocal serial
        serial += 1
        heapq.heappush(heap, (total, serial, packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or heap[0][0] + length > most:
                each = most // length
                if left >= each:
                    push(each * length, left // each, ((length, each),))
                if left % each:
                    push(left % each * length, 1, ((length, left % each),))
                break
            total, _, packs, pattern = heapq.heappop(heap)
            # as many in each pack as bring it up to the next shortest, at least one
            room = (most - total) // length
            goal = heap[0][0] if heap else most
            each = max(1, min(room, -(-(goal - total) // length), left // packs or 1))
            take = min(packs, left // each)
            push(total + each * length, take, (*pattern, (length, each)))
            if packs > take:
                push(total, packs - take, pattern)
            left -= take * each
    return [(packs, pattern) for _, _, packs, pattern in heap]


def fill(patterns: list, most: int = LENGTH) -> list[tuple[int, tuple, tuple[tuple[int, int, int, int], ...]]]:
    """[(packs, pattern, parts), ...] for a plan: what lies in too empty packs moves together, cut where it has to be.

    As many of the shortest packs are taken apart as the room of the others allows, so that in the end less than one
    whole pack and a ``SLACK``-th of each other is empty. A part (length, first rank, from, to) is a stretch of a piece of that length; the
    first pack has it of the piece with the first rank, the next pack of the next one. Like the plan, this works on counts.
    """
    serial = itertools.count()
    done, under = [], []
    for packs, pattern in patterns:
        total = sum(length * each for length, each in pattern)
        if most - total > most // SLACK:
            under.append((total, pattern, packs))
        else:
            done.append((packs, pattern, ()))
    needless = sum((most - total) * packs for total, _, packs in under) // most
    ranks: dict[int, int] = defaultdict(int)
    moved: list[tuple] = []
    room: list[tuple] = []
    for total, pattern, packs in sorted(under):
        gone = min(packs, needless)
        needless -= gone
        for length, each in pattern if gone else ():
            heapq.heappush(moved, (-length, next(serial), length, 0, ranks[length], gone * each))
            ranks[length] += gone * each
        if packs > gone:
            heapq.heappush(room, (total, next(serial), packs - gone, pattern, ()))
    while moved:
        left, _, length, at, first, count = heapq.heappop(moved)
        total, _, packs, pattern, parts = heapq.heappop(room)
        size, take = min(-left, most - total), min(count, packs)
        each = min((most - total) // size, count // take)
        if packs > take:
            heapq.heappush(room, (total, next(serial), packs - take, pattern, tuple((a, b + take, c, d) for a, b, c, d in parts)))
        parts += tuple((length, first + k * take, at, at + size) for k in range(each))
        total += each * size
        if total < most:
            heapq.heappush(room, (total, next(serial), take, pattern, parts))
        else:
            done.append((take, pattern, parts))
        if size < -left:
            heapq.heappush(moved, (left + size, next(serial), length, at + size, first, take * each))
        if count > take * each:
            heapq.heappush(moved, (left, next(serial), length, at, first + take * each, count - take * each))
    return done + [(packs, pattern, parts) for _, _, packs, pattern, parts in room]


def slots(filled: list) -> dict[int, np.ndarray]:
    """By length the rows (first rank, end of ranks, from, to, first sequence, offset) of its places in the filled plan, by rank."""
    used: dict[int, int] = defaultdict(int)
    for packs, _, parts in filled:
        for length, first, _, _ in parts:
            used[length] = max(used[length], first + packs)
    out: dict[int, list] = defaultdict(list)
    base = 0
    for packs, pattern, parts in sorted(filled, key=lambda x: (x[1:], x[0])):
        at = 0
        for length, each in pattern:
            for _ in range(each):
                out[length].append((used[length], used[length] + packs, 0, length, base, at))
                used[length] += packs
                at += length
        for length, first, a, b in parts:
            out[length].append((first, first + packs, a, b, base, at))
            at += b - a
        base += packs
    return {k: np.array(sorted(v), np.int64) for k, v in out.items()}


def pieces(docs: DataFrame, path: str, most: int) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=4 << 20):
            ids, offsets = encoder(path).encode(batch.column("text"))
            raw = ids.astype("<u4").tobytes()
            total = np.diff(offsets)
            n = -(-total // most)
            row = np.repeat(np.arange(batch.num_rows), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * most
            length = np.minimum(total[row] - start, most)
            first = 4 * (offsets[row] + start)
            parts = [raw[a : a + 4 * b] for a, b in zip(first.tolist(), length.tolist(), strict=True)]
            crc = np.fromiter(map(zlib.crc32, parts), np.int64, len(parts))
            columns = {"doc_id": batch.column("doc_id").take(pa.array(row)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc), "doc_tokens": pa.array(total[row]), "ids": pa.array(parts, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)
        forget(path)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str | None = None, most: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with ``with_ids``, ids.

    A document's ids and its end id are cut every ``most`` ids, and where sequences would stay too empty (``fill``); ``ids`` holds a piece's
    as little-endian unsigned 32-bit integers. In each sequence the pieces lie one behind the other from 0; what is left up to ``most`` is
    padding: less than one sequence and a ``SLACK``-th of all others, whatever the lengths. Null text
    counts as empty and gives a piece of one id; rows that share a doc_id, null included, are documents of their own.
    """
    table = materialize(pieces(docs, path or default_vocabulary(), most), "pieces")
    spark = docs.sparkSession
    histogram = {r[0]: r[1] for r in table.groupBy("length").count().collect()}  # one row a length
    places = slots(fill(plan(histogram, most), most))
    # pieces of a length are ranked in parts of about PART rows, as many as the length needs; ids go along where some are cut
    cut = {k for k, rows in places.items() if (rows[:, 3] - rows[:, 2] < k).any()}
    dealt = F.broadcast(spark.createDataFrame([(k, n // PART + 1, with_ids or k in cut) for k, n in histogram.items()], "length long, parts long, needed boolean"))
    parted = table.join(dealt, "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "parts")).withColumn("ids", F.when(F.col("needed"), F.col("ids"))).drop("parts", "needed")
    counts = materialize(parted.groupBy("length", "part").count(), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    ranked = parted.withColumn("at", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1)
    # a few thousand lengths and a row for each PART pieces
    ranked = ranked.join(F.broadcast(base.drop("count")), ["length", "part"]).withColumn("rank", F.col("base") + F.col("at")).drop("part", "at", "base")
    sent = spark.sparkContext.broadcast(places)

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "ids", rows=10_000):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            order = np.lexsort((rank, length))
            kinds, first = np.unique(length[order], return_index=True)
            found = []
            for n, mine in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
                # each place holds a stretch of ranks, and a piece that is cut has several places
                rows = sent.value[n]
                low, high = np.searchsorted(rank[mine], rows[:, 0]), np.searchsorted(rank[mine], rows[:, 1])
                for k in np.flatnonzero(low < high).tolist():
                    at = mine[low[k] : high[k]]
                    start, end, sequence, offset = rows[k, 2:]
                    found.append((at, np.full(len(at), start), np.full(len(at), end - start), sequence + rank[at] - rows[k, 0], np.full(len(at), offset)))
            at, start, size, sequence, offset = map(np.concatenate, zip(*found, strict=True))
            ids, crc = batch.column("ids").take(pa.array(at)), batch.column("ids_crc32").to_numpy()[at]
            parts = ids.to_pylist() if with_ids else [None] * len(at)
            for k in np.flatnonzero(size < length[at]).tolist():
                parts[k] = ids[k].as_py()[4 * start[k] : 4 * (start[k] + size[k])]
                crc[k] = zlib.crc32(parts[k])
            columns = {"doc_id": batch.column("doc_id").take(pa.array(at)), "start": pa.array(batch.column("start").to_numpy()[at] + start), "length": pa.array(size), "ids_crc32": pa.array(crc), "doc_tokens": batch.column("doc_tokens").take(pa.array(at))}
            if with_ids:
                columns["ids"] = pa.array(parts, pa.binary())
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return ranked.mapInArrow(place, kinds + ", sequence_id long, offset long")
