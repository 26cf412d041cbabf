"""Arrow and numpy helpers that tasks share: text as bytes, words, hashes, packed records."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that a task works on at a time.
CHUNK_BYTES = 4 << 20
#: Space and the five control characters from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def give_back() -> None:
    """Return freed memory to the system, as workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A task's function over batches that gives its memory back at its end."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch], *more) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches, *more)
        finally:
            give_back()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(salt << 32)) * U64(0x9E3779B97F4A7C15))


BYTE_VALUE = seeds(256, 7)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the row offsets into them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most so many rows and bytes of text; a longer text stands alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(sizes)
        at, n = 0, batch.num_rows
        while at < n:
            before = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, before + most, "right")), at + 1), at + rows, n)
            yield batch.slice(at, to - at)
            at = to


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each byte the row that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all given spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes that are no white space; none crosses a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = solid[heads]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    stops[tails] = solid[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


_POWERS = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """The first n powers of a fixed odd base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 1024), U64(0xD6E8FEB86659FD93))
        base[0] = U64(1)
        _POWERS = np.multiply.accumulate(base)
    return _POWERS[:n]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, U64)
    length = end - start
    at = spans(start, length)
    first = np.cumsum(length) - length
    value = BYTE_VALUE[data[at]] * powers(int(length.max()))[np.arange(len(at)) - np.repeat(first, length)]
    return mix(np.add.reduceat(value, first) ^ length.astype(U64))


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """(a number from 0 for each word, equal for equal words alone; how many numbers there are)."""
    length = end - start
    offsets = np.append(0, np.cumsum(length))
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[spans(start, length)])])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, n_rows: int) -> pa.Array:
    """By row its words (given in order of rows) joined by one space, as text; empty without words."""
    length = end - start + 1
    out = np.full(int(length.sum()), 0x20, np.uint8)
    out[spans(np.cumsum(length) - length, length - 1)] = data[spans(start, length - 1)]
    size = np.bincount(row, weights=length, minlength=n_rows).astype(np.int64)
    last = np.ones(len(out), bool)
    last[np.cumsum(size)[size > 0] - 1] = False
    offsets = np.append(0, np.cumsum(np.maximum(size - 1, 0)))
    return pa.Array.from_buffers(pa.large_string(), n_rows, [None, pa.py_buffer(offsets), pa.py_buffer(out[last])])


def shingle_hashes(word: np.ndarray, row: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every n-word shingle; a row of fewer words gives its whole sequence as one."""
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    factor = seeds(n, 11) | U64(1)
    total = len(word)
    h = np.zeros(max(total - n + 1, 0), U64)
    for j in range(n):
        h += word[j : j + len(h)] * factor[j]
    keep = np.flatnonzero(row[: len(h)] == row[n - 1 : n - 1 + len(h)])
    short = np.flatnonzero((count > 0) & (count < n))
    tails = np.zeros(len(short), U64)
    for j in range(n - 1):
        has = count[short] > j
        tails[has] += word[first[short[has]] + j] * factor[j]
    tails += count[short].astype(U64) * U64(0x9E3779B97F4A7C15)
    return np.concatenate([mix(h[keep]), mix(tails)]), np.concatenate([row[keep], short])


def blob(*parts: np.ndarray) -> bytes:
    """Arrays behind each other, each with its dtype and length."""
    out = []
    for x in parts:
        x = np.ascontiguousarray(x)
        out += [f"{x.dtype.str:<4}".encode(), np.int64(len(x)).tobytes(), x.tobytes()]
    return b"".join(out)


def unblob(data: bytes) -> list[np.ndarray]:
    """The arrays of a blob."""
    out, at = [], 0
    while at < len(data):
        dtype = np.dtype(data[at : at + 4].decode().strip())
        n = int(np.frombuffer(data, np.int64, 1, at + 4)[0])
        out.append(np.frombuffer(data, dtype, n, at + 12))
        at += 12 + n * dtype.itemsize
    return out


def ids(column: pa.Array, null: int = np.iinfo(np.int64).max) -> np.ndarray:
    """A whole-number column as int64; nulls become the largest value, so they come last."""
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False).astype(np.int64)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of a sorted partition in pieces that hold whole groups."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        edge = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if edge:
            yield table.slice(0, edge).combine_chunks()
        rest = table.slice(edge)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
