"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

One pass turns each text into its shingle count, a key of its set, MinHash
samples folded into bands, and an odd sketch: a bitmap in which each sample
flips one bit, so that the XOR of two sketches counts the samples in which they
differ. Equal sets collapse to their smallest document first. Documents that
share a band and whose sketches are close form candidate clusters; each cluster's
sets are then compared exactly, in blocks, and only confirmed links count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vgraph.llm.arrays import LOWER, U64, chunks, groups, lean, mix, seeds, shingle_hashes, utf8, word_hashes, words
from vgraph.operators.components import connected_components
from vgraph.plans.workspace import materialize

#: Bands, samples in each, and bits of a sketch.
BANDS, ROWS, BITS = 32, 5, 256
#: Sketches that differ in more bits are no candidates. Sets of similarity 0.8 differ in 50 bits
#: give or take 8, so one in a million has more; such sets share about ten bands besides.
FAR = 88
#: A band with more documents makes a cluster without a look at their sketches; documents in a block.
HOT, BLOCK = 4096, 512
#: Rows of a table up to which it is sent to all tasks, and the share of all copies above which a set is one of the few large ones.
SENT, SHARE = 100_000, 10_000
#: Bits of a shingle's hash, below those for its row in a chunk.
_HASH_BITS, _ROWS = 52, 4000


def shingle_sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, row) of the distinct shingles of each row, sorted by row and shingle."""
    data, offsets = utf8(batch.column("text"))
    data = LOWER[data]
    start, end, row = words(data, offsets)
    h, row = shingle_hashes(word_hashes(data, start, end), row, batch.num_rows, n)
    key = np.sort((row.astype(U64) << U64(_HASH_BITS)) | (h >> U64(64 - _HASH_BITS)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key & U64((1 << _HASH_BITS) - 1), (key >> U64(_HASH_BITS)).astype(np.int64)


def signatures(shingles: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bands, sketches) of non-empty sets that lie behind each other."""
    first = np.cumsum(count) - count
    x = mix(shingles).astype(np.uint32)
    factor = seeds(BANDS * ROWS, 3)
    bands = np.zeros((len(count), BANDS), U64)
    bits = np.zeros((len(count), BITS), np.uint8)
    at = np.arange(len(count))
    for i in range(BANDS * ROWS):
        y = (x ^ np.uint32(factor[i] >> U64(32))) * np.uint32(factor[i] | U64(1))
        low = np.minimum.reduceat(y ^ (y >> np.uint32(15)), first).astype(U64)
        bands[:, i // ROWS] = mix(bands[:, i // ROWS] + low + U64(i + 1))
        bits[at, (mix(low + factor[i]) & U64(BITS - 1)).astype(np.int64)] ^= 1
    return bands, np.packbits(bits, axis=1)


def _sign(n: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20, rows=_ROWS):
            shingles, row = shingle_sets(batch, n)
            count = np.bincount(row, minlength=batch.num_rows)
            full = np.flatnonzero(count)
            total = np.zeros((batch.num_rows, 2), U64)
            bands, sketches = np.zeros((0, BANDS), U64), np.zeros((0, BITS // 8), np.uint8)
            if len(full):
                first = np.cumsum(count[full]) - count[full]
                for j, salt in enumerate(seeds(2, 5)):
                    total[full, j] = np.add.reduceat(mix(shingles + salt), first)
                bands, sketches = signatures(shingles, count[full])
            where = np.append(0, np.cumsum(count > 0))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array(count, pa.int64()),
                "key_a": pa.array(total[:, 0].astype(np.int64)),
                "key_b": pa.array(total[:, 1].astype(np.int64)),
                "bands": pa.ListArray.from_arrays(pa.array(where * BANDS, pa.int32()), pa.array(bands.ravel().astype(np.int64))),
                "sketch": pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((where * (BITS // 8)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sketches))]),
            })

    return run


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@lean
def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each band's documents links that connect all whose sketches are close."""
    for table in groups(batches, ["band"]):
        band, doc = table.column("band").to_numpy(), table.column("rep").to_numpy()
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), U64).reshape(-1, BITS // 64)
        begin = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        size = np.diff(np.append(begin, len(band)))
        lead = np.repeat(begin, size)
        near = np.bitwise_count(bits ^ bits[lead]).sum(1) <= FAR
        out = [np.stack([doc[lead[near]], doc[near]], 1)]
        odd = np.add.reduceat((~near).astype(np.int64), begin)
        for b, n in zip(begin[odd > 0], size[odd > 0], strict=True):
            # those far from the first: each against all of the band that it isn't joined with yet
            union = _Union(n)
            for i in np.flatnonzero(near[b : b + n]):
                union.join(0, int(i))
            for i in np.flatnonzero(~near[b : b + n]):
                for j in np.flatnonzero(np.bitwise_count(bits[b : b + n] ^ bits[b + i]).sum(1) <= FAR):
                    if union.find(int(i)) != union.find(int(j)):
                        union.join(int(i), int(j))
                        out.append(np.array([[doc[b + i], doc[b + j]]]))
        pairs = np.concatenate(out)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        yield pa.RecordBatch.from_pydict({"src": pa.array(pairs[:, 0]), "dst": pa.array(pairs[:, 1])})


def similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * intersection reaches percent * union, in whole numbers."""
    return 100 * inter >= percent * (a + b - inter)


def _links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all similar sets; those of the same side, if it is 1 or 2, aren't compared."""
    n, size = len(sets), np.array([len(s) for s in sets])
    union, out = _Union(n), []
    values, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(which, kind="stable")
    owner = owner[order]
    start = np.searchsorted(which[order], np.arange(len(values) + 1))
    position = np.append(0, np.cumsum(size))
    for i in range(n - 1):
        # how often each later set occurs in the lists of this one's shingles
        mine = which[position[i] : position[i + 1]]
        lengths = start[mine + 1] - start[mine]
        at = np.arange(lengths.sum()) + np.repeat(start[mine] - (np.cumsum(lengths) - lengths), lengths)
        inter = np.bincount(owner[at], minlength=n)
        hit = similar(inter, size[i], size, percent)
        hit[: i + 1] = False
        if side[i]:
            hit &= side != side[i]
        for j in np.flatnonzero(hit):
            if union.find(i) != union.find(int(j)):
                union.join(i, int(j))
                out.append((i, int(j)))
    return out


def _confirm(n: int, percent: int, keys: list[str]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            sets = []
            for piece in chunks(table.to_batches(), most=4 << 20, rows=_ROWS):
                shingles, row = shingle_sets(piece, n)
                sets += np.split(shingles, np.searchsorted(row, np.arange(1, piece.num_rows)))
            doc, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
            new = np.zeros(len(doc), bool)
            for k in keys:
                x = table.column(k).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            begin = np.append(0, np.flatnonzero(new))
            src, dst = [], []
            for a, b in zip(begin, np.append(begin[1:], len(doc)), strict=True):
                for i, j in _links(sets[a:b], side[a:b], percent):
                    src.append(doc[a + i])
                    dst.append(doc[a + j])
            yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text).

    Words are runs of characters other than space and tab to carriage return, with
    A-Z lower-cased; a document's set holds its distinct n-word shingles, or its whole
    sequence if that is shorter. Documents are linked where 100 * intersection >=
    percent * union; ``component_id`` is the smallest doc_id that links reach. Without words
    (null text too) a document has no shingles and no links. Rows that share a doc_id count as one
    document for links. A null doc_id gives a null component_id and kept = true. Other columns of ``docs`` aren't read.

    A pair of similarity 0.8 is a candidate with a probability of 1 - 3e-6 and more above.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_sign(n), "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, sketch binary"), "signed")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    # one row for each set, however many documents hold it: tasks aggregate before they shuffle
    lead = known.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    lead = materialize(lead, "lead")
    spread = lead.select("rep", F.explode("bands").alias("band"))
    sizes = materialize(spread.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1"), "sizes")
    big = _sent(sizes.where(F.col("n") > HOT))
    hot = spread.join(big, "band").select(F.col("low").alias("src"), F.col("rep").alias("dst"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cool = materialize(spread.join(big, "band", "left_anti").join(sizes.where(F.col("n") <= HOT).select("band"), "band"), "cool").join(lead.select("rep", "sketch"), "rep")
    close = cool.repartition(parts, "band").sortWithinPartitions("band", "rep").mapInArrow(_close, "src long, dst long")
    clusters = connected_components(close.unionByName(hot).distinct())
    links = materialize(_verified(docs, clusters, n, percent, parts), "links")
    same = _copies(known.select("key_a", "key_b", "doc_id"), lead.where("copies > 1").select("key_a", "key_b", "rep", "copies"))
    groups = connected_components(links.unionByName(same))
    out = signed.select("doc_id", "n_shingles").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _sent(table: DataFrame) -> DataFrame:
    """``table``, for all tasks if it is small; a larger one is joined by key, where Spark splits keys of many rows."""
    return F.broadcast(table) if table.count() <= SENT else table


def _blocks(size: Column) -> Column:
    return F.ceil(size / BLOCK).cast("long")


def _dealt(doc_id: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), blocks)


def _copies(known: DataFrame, reps: DataFrame) -> DataFrame:
    """(src, dst): the first document of each set with all other documents of that set.

    Sets held by more than one in SHARE documents, fewer than SHARE of them by count, are sent
    to all tasks, so that no task gets all copies; the others are joined by key.
    """
    copies = reps.agg(F.sum("copies")).first()[0] or 0
    many = F.col("copies") > max(HOT, copies // SHARE)
    keys = ["key_a", "key_b"]
    sent = F.broadcast(reps.where(many).select(*keys, "rep"))
    found = known.join(sent, keys).unionByName(known.join(sent, keys, "left_anti").join(reps.where(~many).select(*keys, "rep"), keys))
    return found.where("doc_id <> rep").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst"))


def _verified(docs: DataFrame, clusters: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """Exact links that connect all similar documents of each cluster.

    A cluster is dealt into blocks by a hash; its first document goes to each of them. Where
    that leaves a large cluster in several components, the documents outside of the first one's are
    compared with all of the cluster, block by block.
    """
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    sizes = _sent(materialize(sizes.select("component", _blocks(F.col("size")).alias("blocks")), "sizes"))
    numbered = clusters.join(sizes, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    first = F.col("id") == F.col("component")
    home = F.when(first, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(_dealt(F.col("id"), F.col("blocks"))))
    members = materialize(numbered.select(F.col("id").alias("doc_id"), "component", "blocks", F.explode(home).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("side")), "members")
    keys = ["component", "a", "b"]
    # all texts are dealt once; from here on those of the clusters are enough
    docs = materialize(docs.join(clusters.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi"), "texts")

    def run(dealt: DataFrame) -> DataFrame:
        texts = docs.join(dealt.select("doc_id", *keys, "side").hint("merge"), "doc_id")
        return texts.repartition(parts, *keys).sortWithinPartitions(*keys, "doc_id").mapInArrow(_confirm(n, percent, keys), "src long, dst long")

    links = materialize(run(members), "links")
    large = members.where("blocks > 1").select("doc_id", "component", "blocks").distinct()
    if large.isEmpty():
        return links
    now = connected_components(links.join(large.select(F.col("doc_id").alias("src")), "src", "left_semi"))
    held = large.join(now.select(F.col("id").alias("doc_id"), F.col("component").alias("now")), "doc_id", "left")
    held = materialize(held.withColumn("outside", F.coalesce("now", "doc_id") != F.col("component")), "held")
    outer = held.where("outside").groupBy("component").agg(F.count("*").alias("n")).select("component", _blocks(F.col("n")).alias("outer"))
    every = held.join(_sent(materialize(outer, "outer")), "component").withColumn("a", _dealt(F.col("doc_id"), F.col("blocks")))
    rest = every.where("outside").withColumn("b", _dealt(F.col("doc_id"), F.col("outer")))
    left = rest.select("doc_id", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("a"), "b", F.lit(1).alias("side"))
    right = every.select("doc_id", "component", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1)).alias("b"), F.lit(2).alias("side"))
    return links.unionByName(run(left.unionByName(right)))
