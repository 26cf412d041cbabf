"""Substring dedup over windows of words that travel as super-k-mers.

Of the grams of words in a window the one with the smallest hash is its minimiser,
so equal windows have equal minimisers. Consecutive windows that share one,
as many as overlap, are a super-k-mer and travel as one packed string:

1. Documents are packed into blocks. A block sends the hash of each
   minimiser it has once, with the number of distinct super-k-mers that it has there.
2. A bucket of hashes answers which of them two documents have, and which are hot: those of
   more than ``HOT`` super-k-mers in all blocks.
3. For the first a block sends each distinct super-k-mer once, with its smallest document, dealt
   by minimiser. Hot ones are taken apart into windows, which are dealt by
   their own hash: a phrase in most documents fills no bucket, as equal windows are sent once a block.
4. A bucket sorts all windows that it got, word by word and not by hash, and finds the
   smallest document of each class of equal ones. These go back to the blocks, which take out the words.

Hashes only deal windows out; whether windows are equal is told by their words alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vgraph.llm.arrays import U64, blob, give_back, ids, joined, lean, mix, seeds, spans, unblob, utf8, word_hashes, word_ids, words
from vgraph.llm.run_index import _blocks, _deal, _dense, _pack_hashes, _small, _unpack, _unpack_hashes
from vgraph.plans.workspace import materialize

#: Bytes of packed documents to a bucket of hashes and to one of super-k-mers; super-k-mers that make a minimiser hot.
BUCKET_BYTES, SHARD_BYTES, HOT = 8 << 20, 3 << 20, 4096


def _press(*parts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(blob(*parts))


def _parts(data: bytes) -> list[np.ndarray]:
    return unblob(zstandard.ZstdDecompressor().decompress(data))


def window_ranks(word: np.ndarray, n: int) -> np.ndarray:
    """For each place a number that two places share if and only if their next n words are equal; the last n - 1 places mean nothing."""
    many = len(word)
    bits = max(many, 1).bit_length()
    at = np.arange(many)
    rank, width = _dense(word, np.zeros(many, np.int64), 1), 1
    while width < n:
        step = min(width, n - width)
        rank = _dense(rank, rank[np.minimum(at + step, many - 1)], bits)
        width += step
    return rank


class SuperKmers:
    """The super-k-mers of a block: (minimiser of 46 bits, first window, number of windows), in the order of the text."""

    def __init__(self, docs: pa.RecordBatch, n: int):
        self.n, self.doc, self.rows = n, ids(docs.column("doc_id")), docs.num_rows
        self.data, offsets = utf8(docs.column("text"))
        self.start, self.end, self.row = words(self.data, offsets)
        self.word, size = word_ids(self.data, self.start, self.end)
        # each distinct word is hashed once
        at = np.zeros(size, np.int64)
        at[self.word] = np.arange(len(self.word))
        h, k = word_hashes(self.data, self.start[at], self.end[at])[self.word], n // 2 + 1
        self.span = n - k + 1
        many = max(len(h) - n + 1, 0)
        low = mix(_sums(h, k)) >> U64(18)
        width = 1
        while width < self.span and len(low):
            step = min(width, self.span - width)
            low = np.minimum(low[step:], low[: len(low) - step])
            width += step
        low = low[:many]
        valid = np.flatnonzero(self.row[:many] == self.row[n - 1 : n - 1 + many])
        low = low[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (low[1:] != low[:-1]) | (np.diff(valid) > 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(valid)))
        parts = -(-count // self.span)
        inner = self.span * spans(np.zeros(len(parts), np.int64), parts)
        self.first = np.repeat(valid[first], parts) + inner
        self.count = np.minimum(np.repeat(count, parts) - inner, self.span)
        # minima crowd at small values: mixed again, they deal out evenly
        self.hash = mix(np.repeat(low[first], parts) ^ U64(0x9E3779B97F4A7C15)) >> U64(18)
        self.window = mix(_sums(h, n)[:many])

    def requests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(minimiser, distinct super-k-mers, whether two documents have it), sorted."""
        whole = mix(self.window[self.first] * U64(3) + self.window[self.first + self.count - 1] + self.count.astype(U64))
        doc = self.doc[self.row[self.first]]
        order = np.lexsort((whole, self.hash))
        h, whole, doc = self.hash[order], whole[order], doc[order]
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        other = new.copy()
        other[1:] |= whole[1:] != whole[:-1]
        at = np.flatnonzero(new)
        if not len(at):
            return h, np.zeros(0, np.uint16), np.zeros(0, np.uint8)
        several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
        return h[at], np.minimum(np.add.reduceat(other.astype(np.int64), at), 65535).astype(np.uint16), several.astype(np.uint8)

    def wanted(self, hashes: np.ndarray, hot: np.ndarray) -> None:
        """Keep the super-k-mers of these minimisers, those of hot ones by window, and find the distinct ones by ``deal``."""
        order = np.argsort(hashes)
        hashes, hot = hashes[order], hot[order]
        at = np.minimum(np.searchsorted(hashes, self.hash), len(hashes) - 1)
        hit = np.flatnonzero(hashes[at] == self.hash)
        split = hot[at[hit]].astype(bool)
        apart, together = hit[split], hit[~split]
        windows = spans(self.first[apart], self.count[apart])
        first = np.concatenate([self.first[together], windows])
        count = np.concatenate([self.count[together], np.ones(len(windows), np.int64)])
        deal = np.concatenate([self.hash[together], self.window[windows] >> U64(18)])
        rank = window_ranks(self.word, self.n)
        doc = self.doc[self.row[first]]
        # the first and the last window overlap, so they tell the whole
        a, b = rank[first], rank[first + count - 1]
        order = np.lexsort((doc, b, a, count, deal))
        new = np.ones(len(order), bool)
        for x in (b, a, count, deal):
            new[1:] &= x[order][1:] == x[order][:-1]
        new[1:] = ~new[1:]
        new[:1] = True
        self.first, self.count = first, count
        self.distinct = np.empty(len(order), np.int64)
        self.distinct[order] = np.cumsum(new) - 1
        lead = order[new]
        self.deal, self.low, self.lead = deal[lead], doc[lead], lead


def _sums(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    many = max(len(h) - n + 1, 0)
    out = np.zeros(many, U64)
    for j, factor in enumerate(seeds(n, 29) | U64(1)):
        out += h[j : j + many] * factor
    return out


def _requests(n: int, buckets: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                h, weight, several = SuperKmers(_unpack(packed), n).requests()
                cut = _deal(h, buckets)
                full = np.flatnonzero(np.diff(cut))
                parts = [slice(cut[b], cut[b + 1]) for b in full]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int64()), "block": pa.array(np.full(len(full), block), pa.int64()), "hashes": pa.array([_pack_hashes(h[p]) for p in parts], pa.binary()), "weights": pa.array([_press(weight[p], several[p]) for p in parts], pa.binary())})

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """For each block of a bucket those of its minimisers that two documents have, and which of them are hot."""
    parts = [_unpack_hashes(x) for x in table.column("hashes").to_pylist()]
    weights = [_parts(x) for x in table.column("weights").to_pylist()]
    every, at = np.unique(np.concatenate(parts), return_inverse=True)
    docs = np.bincount(at, weights=np.concatenate([1 + w[1].astype(np.int64) for w in weights]))
    total = np.bincount(at, weights=np.concatenate([w[0] for w in weights]))
    block, hashes, hot = [], [], []
    a = 0
    for b, part in zip(table.column("block").to_pylist(), parts, strict=True):
        mine = at[a : a + len(part)]
        a += len(part)
        mine = mine[docs[mine] >= 2]
        if len(mine):
            block.append(b)
            hashes.append(_pack_hashes(every[mine]))
            hot.append(_press((total[mine] > HOT).astype(np.uint8)))
    return pa.table({"block": pa.array(block, pa.int64()), "hashes": pa.array(hashes, pa.binary()), "hot": pa.array(hot, pa.binary())})


def _asked(docs: pa.RecordBatch, wanted: list[dict], n: int) -> SuperKmers:
    kmers = SuperKmers(docs, n)
    kmers.wanted(np.concatenate([_unpack_hashes(w["hashes"]) for w in wanted]), np.concatenate([_parts(w["hot"])[0] for w in wanted]))
    return kmers


def _contexts(n: int, shards: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed, wanted in zip(*(batch.column(x).to_pylist() for x in ("block", "docs", "wanted")), strict=True):
                k = _asked(_unpack(packed), wanted, n)
                cut = _deal(k.deal, shards)
                full = np.flatnonzero(np.diff(cut))
                out = []
                for s in full:
                    lead, low = k.lead[cut[s] : cut[s + 1]], k.low[cut[s] : cut[s + 1]]
                    at = spans(k.first[lead], k.count[lead] + n - 1)
                    text = joined(k.data, k.start[at], k.end[at], np.zeros(len(at), np.int64), 1)
                    out.append(_press(utf8(text)[0], k.count[lead].astype(np.uint8), _small(low)))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(full, pa.int64()), "block": pa.array(np.full(len(full), block), pa.int64()), "data": pa.array(out, pa.binary())})

    return run


def _answers(n: int):
    def run(table: pa.Table) -> pa.Table:
        """The smallest document of each window that was sent."""
        raw = [_parts(x) for x in table.column("data").to_pylist()]
        data = np.concatenate([x for p in raw for x in (p[0], np.array([0x20], np.uint8))])
        count, low = np.concatenate([p[1] for p in raw]).astype(np.int64), np.concatenate([p[2].astype(np.int64) for p in raw])
        start, end, _ = words(data, np.array([0, len(data)]))
        rank = window_ranks(word_ids(data, start, end)[0], n)
        size = count + n - 1
        at = spans(np.cumsum(size) - size, count)
        first = np.full(len(rank), np.iinfo(np.int64).max)
        np.minimum.at(first, rank[at], np.repeat(low, count))
        found = first[rank[at]]
        cut = np.append(0, np.cumsum([int(p[1].sum(dtype=np.int64)) for p in raw]))
        out = [_press(_small(found[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        give_back()
        return pa.table({"block": table.column("block").cast(pa.int64()), "shard": table.column("shard").cast(pa.int64()), "data": pa.array(out, pa.binary())})

    return run


def removed(docs: pa.RecordBatch, wanted: list[dict], answers: list[dict], n: int) -> tuple[SuperKmers, np.ndarray]:
    """A block's words, and which of them go."""
    if not wanted:
        k = SuperKmers(docs, n)
        return k, np.zeros(len(k.start), bool)
    k = _asked(docs, wanted, n)
    first = np.concatenate([_parts(x["data"])[0].astype(np.int64) for x in sorted(answers, key=lambda x: x["shard"])])
    size = k.count[k.lead]
    begin = (np.cumsum(size) - size)[k.distinct]
    at = spans(k.first, k.count)
    mark = first[spans(begin, k.count)] < k.doc[k.row[at]]
    starts = np.zeros(len(k.start) + n, np.int64)
    np.add.at(starts, at[mark], 1)
    np.add.at(starts, at[mark] + n, -1)
    return k, np.cumsum(starts)[: len(k.start)] > 0


def _cut(n: int, schema: pa.Schema):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, wanted, answers in zip(*(batch.column(x).to_pylist() for x in ("docs", "wanted", "answers")), strict=True):
                docs = _unpack(packed)
                k, gone = removed(docs, wanted, answers, n)
                kept = np.flatnonzero(~gone)
                count = np.bincount(k.row, minlength=k.rows)
                own = {"n_words": pa.array(count), "n_removed": pa.array(count - np.bincount(k.row[kept], minlength=k.rows)), "kept_text": joined(k.data, k.start[kept], k.end[kept], k.row[kept], k.rows)}
                yield pa.RecordBatch.from_arrays([(own[f.name] if f.name in own else docs.column(f.name)).cast(f.type) for f in schema], schema=schema)

    return run


def dedup_windows(docs: DataFrame, n: int = 13) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more) without repeated windows of n words (2 to 200).

    Each word of a text goes that a window covers whose words in a row also start in a row with a smaller
    ``doc_id``; windows never cross rows. Added are n_words, n_removed and ``kept_text``, the kept
    words joined by one space. Columns of ``docs`` with these names are replaced. Rows that share a doc_id take nothing from
    each other; a null doc_id counts as larger than all others; null text has no words and gives empty kept_text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if not 2 <= n <= 200:
        raise ValueError("n must be from 2 to 200")
    new = StructType.fromDDL("n_words long, n_removed long, kept_text string")
    docs = docs.select([docs[c] for c in docs.columns if c not in new.names]).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    schema = StructType([*docs.schema, *new])
    blocks = materialize(docs.mapInArrow(_blocks(), "block long, docs binary"), "blocks")
    size = int(blocks.agg(F.coalesce(F.sum(F.length("docs")), F.lit(0))).first()[0])
    buckets, shards = size // BUCKET_BYTES + 1, size // SHARD_BYTES + 1
    requests = blocks.mapInArrow(_requests(n, buckets), "bucket long, block long, hashes binary, weights binary")
    found = requests.groupBy("bucket").applyInArrow(_repeated, "block long, hashes binary, hot binary")
    wanted = materialize(found.groupBy("block").agg(F.collect_list(F.struct("hashes", "hot")).alias("wanted")), "wanted")
    asked = blocks.join(wanted, "block")
    contexts = asked.mapInArrow(_contexts(n, shards), "shard long, block long, data binary")
    answers = contexts.groupBy("shard").applyInArrow(_answers(n), "block long, shard long, data binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias("answers"))
    final = blocks.join(wanted.join(answers, "block"), "block", "left")
    return final.mapInArrow(_cut(n, to_arrow_schema(schema)), schema)
