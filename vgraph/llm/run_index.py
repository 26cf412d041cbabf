"""Suffix-array dedup with a run-length index.

Bytes are removed that lie in a string of ``least`` bytes which also starts in
a document with a smaller id. The work is dealt in four steps, each ended by a
written table:

1. Documents are packed into blocks. In each window of ``least`` bytes the
   smallest hash of a k-gram marks an anchor, so equal windows have equal
   anchors. Each block sends its distinct anchor hashes, dealt by hash.
2. Hashes seen in two documents or more go back to the blocks that sent them,
   with a mark on those that are hot: that have more than ``HOT`` contexts.
3. For those, a block sends each distinct context - the bytes of all windows
   with that anchor - once, with its smallest document, dealt by anchor. Contexts of
   hot anchors are taken apart into windows, which are dealt by their own hash, so a
   phrase amid different text in most documents fills no shard.
4. Each shard sorts the suffixes of its contexts, keeps the run-length
   encoded Burrows-Wheeler transform with samples at the run ends, and streams
   all contexts through it by backward steps. The statistic it reads off at each
   window is whether the match with a smaller document is ``least`` long.
   Blocks turn the answers into removed bytes.

The number of shards follows the size of the input; an anchor has a bounded number of
contexts in its shard, and a passage in a third of all documents is sent once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vgraph.llm.arrays import BYTE_VALUE, U64, blob, chunks, give_back, ids, lean, mix, powers, spans, unblob, utf8
from vgraph.plans.workspace import materialize

#: Text bytes in a block; bytes of packed documents to a bucket of hashes and to a shard; bytes in
#: an index and in a piece of text that is hashed at a time; contexts that are hashed at a time, and those that make an anchor hot.
BLOCK_BYTES, BUCKET_BYTES, SHARD_BYTES, INDEX_BYTES, STEP, SLICE, HOT = 4 << 20, 8 << 20, 3 << 20, 300_000, 1 << 17, 1 << 14, 4096
_NONE = np.iinfo(np.int64).max


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpack(data: bytes) -> pa.RecordBatch:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return pa.ipc.open_stream(raw).read_next_batch()


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of 46 bits, first window, number of windows) of each anchor; windows never cross a row.

    The anchor of a window is the smallest hash of its k-grams, with k about half the
    window, so that it depends on the window's bytes alone; windows in a row that share
    it, as many as overlap, are one. The bytes are worked on in pieces that stay in a processor's cache.
    """
    k = least // 2 + 1
    many = max(len(data) - least + 1, 0)
    span = least - k + 1
    found = [np.zeros((2, 0), U64)]
    for a in range(0, many, STEP):
        low = mix(_grams(data[a : a + STEP + least - 1], k)) >> U64(18)
        width = 1
        while width < span:
            step = min(width, span - width)
            low = np.minimum(low[step:], low[: len(low) - step])
            width += step
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        found.append(np.stack([first.astype(U64) + U64(a), low[first]]))
    first, h = np.concatenate(found, 1)
    if not len(first):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none
    new = np.append(True, h[1:] != h[:-1])
    first, h = first[new].astype(np.int64), h[new]
    # runs end with their row, and every ``span`` windows
    heads = offsets[:-1][(np.diff(offsets) >= least) & (offsets[:-1] < many)]
    heads = heads[first[np.minimum(np.searchsorted(first, heads), len(first) - 1)] != heads]
    order = np.argsort(np.concatenate([first, heads]), kind="stable")
    h = np.concatenate([h, h[np.searchsorted(first, heads, "right") - 1]])[order]
    first = np.concatenate([first, heads])[order]
    row = np.searchsorted(offsets, first, "right") - 1
    count = np.minimum(np.append(first[1:], many), offsets[row + 1] - least + 1) - first
    h, first, count = h[count > 0], first[count > 0], count[count > 0]
    parts = -(-count // span)
    at = np.repeat(first, parts) + span * spans(np.zeros(len(parts), np.int64), parts)
    count = np.minimum(np.repeat(first + count, parts) - at, span)
    # window minima crowd at small values: mixed again, they deal out evenly
    return mix(np.repeat(h, parts) ^ U64(0x9E3779B97F4A7C15)) >> U64(18), at, count


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes, joined from those of powers of two."""
    power, h, size = powers(k + 1), BYTE_VALUE[data], 1
    got, got_len = None, 0
    while True:
        if k & size:
            got = h if got is None else got[: len(h) - got_len] * power[size] + h[got_len:]
            got_len += size
        if 2 * size > k:
            return got
        h = h[:-size] * power[size] + h[size:]
        size *= 2


def _blocks():
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, most=BLOCK_BYTES, rows=20000):
            n += 1
            yield pa.RecordBatch.from_pydict({"block": pa.array([(task << 24) + n], pa.int64()), "docs": pa.array([_pack(batch)], pa.binary())})

    return run


def _pack_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes of 46 bits: 32 each, and the numbers of those with the same leading 14."""
    heads = np.bincount((h >> U64(32)).astype(np.int64), minlength=1 << 14).astype(np.int32)
    return zstandard.ZstdCompressor(level=1).compress(blob(heads, h.astype(np.uint32)))


def _unpack_hashes(data: bytes) -> np.ndarray:
    heads, low = unblob(zstandard.ZstdDecompressor().decompress(data))
    return (np.repeat(np.arange(1 << 14, dtype=U64), heads) << U64(32)) | low


def _deal(h: np.ndarray, n: int) -> np.ndarray:
    """Where each of n even parts of the sorted hashes begins."""
    return np.searchsorted((h >> U64(16)).astype(np.int64) * n >> 30, np.arange(n + 1))


def _ends(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each context by its length, first and last eight bytes, where contexts of an anchor differ most."""
    out = length.astype(U64)
    for j in range(8):
        out = out * U64(0x9E3779B97F4A7C15) + data[first + np.minimum(j, length - 1)]
        out = out * U64(0xBF58476D1CE4E5B9) + data[first + np.maximum(length - 1 - j, 0)]
    return out


def _requests(least: int, buckets: int):
    """The distinct anchor hashes of each block, twice if the block has one in two documents, and their numbers of contexts in the block."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                docs = _unpack(packed)
                data, offsets = utf8(docs.column("text"))
                h, first, count = anchors(data, offsets, least)
                doc = ids(docs.column("doc_id"))[np.searchsorted(offsets, first, "right") - 1]
                ends = _ends(data, first, count + least - 1)
                order = np.argsort(h)
                h, doc, ends = h[order], doc[order], ends[order]
                starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                if not len(starts):
                    continue
                several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
                contexts = np.diff(np.append(starts, len(h)))
                # where an anchor comes more than once its contexts are told apart
                of = np.repeat(np.arange(len(starts)), contexts)
                many = np.flatnonzero(contexts[of] > 1)
                pair = np.lexsort((ends[many], of[many]))
                a, e = of[many][pair], ends[many][pair]
                again = np.append(False, (a[1:] == a[:-1]) & (e[1:] == e[:-1])) if len(a) else np.zeros(0, bool)
                contexts -= np.bincount(a[again], minlength=len(starts))
                cut = _deal(h[starts], buckets)
                full = np.flatnonzero(np.diff(cut))
                parts = [slice(cut[b], cut[b + 1]) for b in full]
                hashes = [_pack_hashes(np.repeat(h[starts[p]], 1 + several[p])) for p in parts]
                weights = [zstandard.ZstdCompressor(level=1).compress(np.minimum(contexts[p], 65535).astype(np.uint16).tobytes()) for p in parts]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int64()), "block": pa.array(np.full(len(full), block), pa.int64()), "hashes": pa.array(hashes, pa.binary()), "weights": pa.array(weights, pa.binary())})

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """For each block of a bucket those of its hashes that two documents have, and of these the hot ones."""
    parts = [_unpack_hashes(x) for x in table.column("hashes").to_pylist()]
    weights = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint16) for x in table.column("weights").to_pylist()]
    every = np.sort(np.concatenate(parts))
    wanted = np.unique(every[1:][every[1:] == every[:-1]])
    total = np.zeros(len(wanted), np.int64)
    hits = []
    for part, weight in zip(parts, weights, strict=True):
        part = np.unique(part)
        at = np.minimum(np.searchsorted(wanted, part), max(len(wanted) - 1, 0))
        hit = wanted[at] == part if len(wanted) else np.zeros(len(part), bool)
        total[at[hit]] += weight[hit]
        hits.append(at[hit])
    out_block, out, hot = [], [], []
    for block, at in zip(table.column("block").to_pylist(), hits, strict=True):
        if len(at):
            out_block.append(block)
            out.append(_pack_hashes(wanted[at]))
            hot.append(wanted[at[total[at] > HOT]].tobytes())
    return pa.table({"block": pa.array(out_block, pa.int64()), "hashes": pa.array(out, pa.binary()), "hot": pa.array(hot, pa.binary())})


class Contexts:
    """The contexts of a block's repeated anchors: where each occurs, and the distinct ones by what they are dealt by.

    That is the anchor, or for the windows of a hot one the window.
    """

    def __init__(self, docs: pa.RecordBatch, wanted: list[dict], least: int):
        self.data, self.offsets = utf8(docs.column("text"))
        self.doc = ids(docs.column("doc_id"))
        h, first, count = anchors(self.data, self.offsets, least)
        want = np.sort(np.concatenate([_unpack_hashes(x["hashes"]) for x in wanted]))
        hot = np.sort(np.frombuffer(b"".join(x["hot"] for x in wanted), U64))
        hit = want[np.minimum(np.searchsorted(want, h), len(want) - 1)] == h
        h, first, count = h[hit], first[hit], count[hit]
        apart = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
        windows = spans(first[apart], count[apart])
        self.first = np.concatenate([first[~apart], windows])
        self.count = np.concatenate([count[~apart], np.ones(len(windows), np.int64)])
        length = self.count + least - 1
        key = np.zeros(len(length), U64)
        for a in range(0, len(length), SLICE):
            mine = slice(a, a + SLICE)
            begin = np.cumsum(length[mine]) - length[mine]
            value = BYTE_VALUE[self.data[spans(self.first[mine], length[mine])]] * powers(2 * least)[spans(np.zeros(len(begin), np.int64), length[mine])]
            key[mine] = mix(np.add.reduceat(value, begin) ^ length[mine].astype(U64))
        h = np.concatenate([h[~apart], mix(key[len(key) - len(windows) :]) >> U64(18)])
        self.row = np.searchsorted(self.offsets, self.first, "right") - 1
        doc = self.doc[self.row]
        order = np.lexsort((doc, key, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])
        self.context = np.empty(len(order), np.int64)
        self.context[order] = np.cumsum(new) - 1
        lead = order[new]  # of each distinct context the occurrence in the smallest document
        self.hash, self.key, self.low, self.start, self.length = h[lead], key[lead], doc[lead], self.first[lead], length[lead]


def _contexts(least: int, shards: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed, wanted in zip(*(batch.column(x).to_pylist() for x in ("block", "docs", "wanted")), strict=True):
                c = Contexts(_unpack(packed), wanted, least)
                cut = _deal(c.hash, shards)
                full = np.flatnonzero(np.diff(cut))
                out = []
                for s in full:
                    a, b = cut[s], cut[s + 1]
                    text = c.data[spans(c.start[a:b], c.length[a:b])]
                    # the anchor's last byte parts a shard into smaller indexes
                    sub = c.hash[a:b].astype(np.uint8)
                    out.append(zstandard.ZstdCompressor(level=3).compress(blob(text, c.length[a:b].astype(np.uint16), _small(c.low[a:b]), sub, c.key[a:b])))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(full, pa.int64()), "block": pa.array(np.full(len(full), block), pa.int64()), "data": pa.array(out, pa.binary())})

    return run


def _small(x: np.ndarray) -> np.ndarray:
    """In 32 bits if all fit."""
    return x.astype(np.uint32) if len(x) and x.min() >= 0 and x.max() < 1 << 32 else x


def _dense(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """The rank of each pair among the distinct pairs; ``low`` has so many bits."""
    n = len(high)
    place = max(n - 1, 1).bit_length()
    if int(high.max(initial=0)).bit_length() + bits + place <= 63:
        # one word for pair and place: sorting words is faster than finding their order
        word = np.sort(high << bits + place | low << place | np.arange(n))
        order, ordered = word & (1 << place) - 1, word >> place
    else:
        order = np.lexsort((low, high))
        ordered = None
    new = np.zeros(n, np.int64)
    new[1:] = ordered[1:] != ordered[:-1] if ordered is not None else (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    return rank


class RunIndex:
    """A run-length encoded Burrows-Wheeler transform of many short texts.

    ``data`` holds the texts behind each other and ``length`` their lengths. Each
    text ends in a terminator of its own, smaller than all bytes and ordered as
    the texts are. Kept are the runs, a sample (text, offset) at each run's end,
    and where each class of suffixes begins that share ``least`` bytes; all else is found from these.
    """

    def __init__(self, data: np.ndarray, length: np.ndarray, least: int):
        m, self.length = len(length), length
        begin = np.cumsum(length + 1) - (length + 1)
        n = int((length + 1).sum())
        text = np.zeros(n, np.int64)
        text[spans(begin, length)] = data.astype(np.int64) + 1
        owner = np.repeat(np.arange(m), length + 1)
        stop = begin + length
        left = stop[owner] - np.arange(n)
        # four bytes fit a word with their place; what ends within them is told apart by its text
        key = np.zeros(n, np.int64)
        for j in range(4):
            key = key << 9 | np.where(left >= j, text[np.minimum(np.arange(n) + j, n - 1)], 0)
        bits = n.bit_length()
        rank = _dense(key >> 9, key & 511, 9)
        rank = _dense(rank, np.where(left < 4, owner + 1, 0), bits)
        width, kept = 4, {}
        while width < int(length.max(initial=0)) + 1:
            kept[width] = rank
            ahead = np.where(left >= width, rank[np.minimum(np.arange(n) + width, n - 1)] + 1, 0)
            rank = _dense(rank, ahead, bits)
            width *= 2
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        before = np.where(place == begin[owner[place]], 0, text[place - 1])
        # a text's first suffix is preceded by its own terminator
        change = np.ones(n, bool)
        change[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.starts = np.flatnonzero(change).astype(np.int32)
        self.ends = np.append(self.starts[1:], n) - 1
        self.chars = before[self.starts]
        sizes = np.diff(np.append(self.starts, n))
        by_char = np.argsort(self.chars, kind="stable")
        target = np.empty(len(by_char), np.int32)
        target[by_char] = np.cumsum(sizes[by_char]) - sizes[by_char]
        self.target = target
        ends = place[self.ends]
        self.sample_text, self.sample_at = owner[ends], ends - begin[owner[ends]]
        # classes: neighbours in order that share `least` bytes
        half = max((w for w in kept if w <= least), default=0)
        whole = left[place] >= least
        same = np.zeros(n, bool)
        if half and whole.any():
            r, shift = kept[half], least - half
            parts = [0, shift] if 2 * half >= least else [*range(0, least - half, half), shift]
            same[1:] = whole[1:] & whole[:-1]
            for s in parts:
                x = r[np.minimum(place + s, n - 1)]
                same[1:] &= x[1:] == x[:-1]
        elif whole.any():
            raise ValueError("least must be 7 bytes or more")
        self.classes = np.flatnonzero(whole & ~same).astype(np.int32)

    def stream(self, texts: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Walk the given texts from their ends in step: (bytes read, texts, class) for each whole window.

        Where a walk meets the end of a run it must be at the place that the run's sample names.
        """
        left = self.length[texts].astype(np.int64)
        order = np.argsort(-left, kind="stable")
        texts, left = texts[order], left[order]
        rank = texts.astype(np.int32)  # the terminators come first, in the order of the texts
        for done in range(1, int(left.max(initial=0)) + 1):
            live = int(np.searchsorted(-left, -done, "right"))
            run = np.searchsorted(self.starts, rank, "right") - 1
            at = np.flatnonzero(rank == self.ends[run])
            if (self.sample_text[run[at]] != texts[: len(rank)][at]).any() or (self.sample_at[run[at]] != left[: len(rank)][at] - done + 1).any():
                raise AssertionError("the index doesn't fit its texts")
            # the rank of the suffix that is one byte longer
            rank = (self.target[run] + rank - self.starts[run])[:live]
            if done >= least:
                yield done, texts[:live], np.searchsorted(self.classes, rank, "right") - 1


def _answers(least: int):
    def run(table: pa.Table) -> pa.Table:
        undo = zstandard.ZstdDecompressor()
        raw = [unblob(undo.decompress(x)) for x in table.column("data").to_pylist()]
        text, length, doc, sub, key = (np.concatenate([x[i] for x in raw]) for i in range(5))
        length, doc = length.astype(np.int64), doc.astype(np.int64)
        cut = np.append(0, np.cumsum([len(x[1]) for x in raw]))
        start = np.cumsum(length) - length
        order = np.lexsort((doc, key, sub))
        new = np.ones(len(order), bool)
        new[1:] = (sub[order][1:] != sub[order][:-1]) | (key[order][1:] != key[order][:-1])
        one = np.empty(len(order), np.int64)
        one[order] = np.cumsum(new) - 1
        lead = order[new]  # of each distinct context the row with the smallest document
        low, size, begin, sub = doc[lead], length[lead], start[lead], sub[lead]
        words = int((size.max(initial=least) - least) // 64) + 1
        earlier = np.zeros((len(lead), words), U64)
        part = np.cumsum(size) // INDEX_BYTES
        # whole anchors go to an index: cut only where the anchor's last byte changes
        part = part[np.searchsorted(sub, sub)]
        for a, b in zip(*_bounds(part), strict=True):
            earlier[a:b] = _earlier(text[spans(begin[a:b], size[a:b])], size[a:b], low[a:b], least, words)
        out = [zstandard.ZstdCompressor(level=1).compress(blob(_small(low[one[a:b]]), np.array([words]), earlier[one[a:b]].ravel())) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        shard = table.column("shard").to_pylist()
        give_back()
        return pa.table({"block": table.column("block").cast(pa.int64()), "shard": pa.array(shard, pa.int64()), "data": pa.array(out, pa.binary())})

    return run


def _bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin and end."""
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return begin, np.append(begin[1:], len(x)) if len(x) else begin


def _earlier(text: np.ndarray, size: np.ndarray, low: np.ndarray, least: int, words: int) -> np.ndarray:
    """Bits by context: window j also starts in a context of a smaller document."""
    index = RunIndex(text, size, least)
    seen = list(index.stream(np.arange(len(size)), least))
    first = np.full(len(index.classes), _NONE)
    for _, texts, found in seen:
        np.minimum.at(first, found, low[texts])
    bits = np.zeros((len(size), words), U64)
    for done, texts, found in seen:
        at = size[texts] - done
        hit = first[found] < low[texts]
        texts, at = texts[hit], at[hit]
        bits[texts, at >> 6] |= U64(1) << (at & 63).astype(U64)
    return bits


def _cut(least: int, schema: pa.Schema, texts: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, wanted, answers in zip(*(batch.column(x).to_pylist() for x in ("docs", "wanted", "answers")), strict=True):
                docs = _unpack(packed)
                data, offsets = utf8(docs.column("text"))
                gone = removed(docs, wanted, answers, least) if wanted else np.zeros(len(data), bool)
                yield _result(docs, data, offsets, gone, schema, texts)

    return run


def removed(docs: pa.RecordBatch, wanted: list[dict], answers: list[dict], least: int) -> np.ndarray:
    """Which bytes of a block go."""
    c = Contexts(docs, wanted, least)
    undo = zstandard.ZstdDecompressor()
    parts = [unblob(undo.decompress(x["data"])) for x in sorted(answers, key=lambda x: x["shard"])]
    low = np.concatenate([p[0].astype(np.int64) for p in parts])
    words = max(int(p[1][0]) for p in parts)
    bits = np.concatenate([np.pad(m := p[2].reshape(len(p[0]), -1), ((0, 0), (0, words - m.shape[1]))) for p in parts])
    later = c.doc[c.row] > low[c.context]
    at = spans(np.zeros(len(c.first), np.int64), c.count)
    of = np.repeat(np.arange(len(c.first)), c.count)
    mark = later[of] | ((bits[c.context[of], at >> 6] >> (at & 63).astype(U64)) & U64(1)).astype(bool)
    starts = np.zeros(len(c.data), np.int64)
    starts[spans(c.first, c.count)[mark]] = 1
    # a byte goes if a marked window starts at it or at most least - 1 bytes before it
    total = np.cumsum(starts)
    total[least:] -= total[:-least].copy()
    return total > 0


def _result(docs, data, offsets, gone, schema, texts) -> pa.RecordBatch:
    n = docs.num_rows
    cover = np.append(0, np.cumsum(gone))
    edge = gone.copy()
    if len(gone):
        edge[1:] &= ~gone[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        edge[heads] = gone[heads]
    runs = np.append(0, np.cumsum(edge))
    digests, kept_texts = [], []
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        part, off = data[a:b], gone[a:b]
        rest = part[~off] if cover[b] > cover[a] else part
        digests.append(hashlib.sha256(rest.tobytes()).hexdigest())
        if texts:
            kept_texts.append(whole_characters(part, off).decode("utf-8"))
    own = {"n_bytes": np.diff(offsets), "n_removed": cover[offsets[1:]] - cover[offsets[:-1]], "n_spans": runs[offsets[1:]] - runs[offsets[:-1]], "kept_sha256": digests, "kept_text": kept_texts}
    columns = [pa.array(own[f.name], f.type) if f.name in own else docs.column(f.name) for f in schema]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def whole_characters(part: np.ndarray, gone: np.ndarray) -> bytes:
    """What is left of UTF-8 text when a character goes only with all its bytes."""
    if not gone.any():
        return part.tobytes()
    char = np.cumsum((part & 0xC0) != 0x80) - 1
    all_gone = np.ones(int(char[-1]) + 1, bool)
    all_gone[char[~gone]] = False
    return part[~all_gone[char]].tobytes()


def remove_repeats(docs: DataFrame, least: int = 50, texts: bool = True) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, more) with repeated passages cut out.

    Each byte of a text goes that lies in a string of ``least`` bytes (7 or more) which
    also starts in a row with a smaller ``doc_id``. Added are n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 of the remaining bytes and, with
    ``texts``, kept_text, where a character goes only if all its bytes go. Columns of ``docs``
    with these names are replaced. Rows that share a doc_id take nothing from each other; a null
    doc_id counts as larger than all others; null text counts as empty and gives empty kept_text.
    """
    spark = docs.sparkSession
    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    docs = docs.select([docs[c] for c in docs.columns if c not in new.names]).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    schema = StructType([*docs.schema, *new])
    blocks = materialize(docs.mapInArrow(_blocks(), "block long, docs binary"), "blocks")
    size = int(blocks.agg(F.coalesce(F.sum(F.length("docs")), F.lit(0))).first()[0])
    buckets, shards = size // BUCKET_BYTES + 1, size // SHARD_BYTES + 1
    requests = blocks.mapInArrow(_requests(least, buckets), "bucket long, block long, hashes binary, weights binary")
    found = requests.groupBy("bucket").applyInArrow(_repeated, "block long, hashes binary, hot binary")
    wanted = materialize(found.groupBy("block").agg(F.collect_list(F.struct("hashes", "hot")).alias("wanted")), "wanted")
    asked = blocks.join(wanted, "block")
    contexts = asked.mapInArrow(_contexts(least, shards), "shard long, block long, data binary")
    answers = contexts.groupBy("shard").applyInArrow(_answers(least), "block long, shard long, data binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias("answers"))
    final = blocks.join(wanted.join(answers, "block"), "block", "left")
    return final.mapInArrow(_cut(least, to_arrow_schema(schema), texts), schema)
