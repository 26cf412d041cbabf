"""Token ids of whole texts with the tokenizers library."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vgraph.llm.arrays import IS_SPACE, LOWER, chunks, lean, spans, utf8

#: Distinct pieces that a task remembers, and the id that ends a document.
WORDS, END = 500_000, 2
#: A normaliser and a splitter under which usual texts, lower-cased, fall into contractions, letters, single digits and runs of signs.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
#: Of each byte of a usual text its kind: usual texts have ASCII signs, white space and Latin letters (two bytes each) only.
GAP, LETTER, DIGIT, SIGN = 0, 1, 2, 3
KIND = np.full(256, SIGN, np.uint8)
KIND[IS_SPACE] = GAP
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = LETTER
ODD = np.zeros(256, bool)
ODD[[x for x in range(32) if not IS_SPACE[x]] + [0x7F, 0xC2, *range(0xCA, 256)]] = True
#: Pairs of bytes that aren't usual: signs of multiplication and division, the dotted capital I, letters beyond U+024F, what begins an added token.
ODD_PAIRS = {0xC3: [0x97, 0xB7], 0xC4: [0xB0], 0xC9: [*range(0x90, 0xC0)], ord("<"): [ord("|")]}


def odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a character that a usual one doesn't."""
    found = [np.flatnonzero(ODD[data])]
    for first, second in ODD_PAIRS.items():
        at = np.flatnonzero(data[:-1] == first)
        found.append(at[np.isin(data[at + 1], second)])
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.concatenate(found), "right") - 1] = True
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pieces, how many each text has) of usual texts, A-Z lower-cased."""
    data = LOWER[data]
    kind = KIND[data]
    before = np.append(np.uint8(GAP), kind[:-1])[: len(kind)]
    heads = offsets[:-1][np.diff(offsets) > 0]
    before[heads] = GAP
    begin = (kind != before) | (kind == DIGIT)
    at = np.flatnonzero((data == ord("'")) & begin)  # contractions: an apostrophe that begins a run of signs, and its letters
    if len(at):
        room = offsets[np.searchsorted(offsets, at, "right")] - at
        one, two = (np.where(room > k, data[np.minimum(at + k, len(data) - 1)], 0) for k in (1, 2))
        size = np.where(np.isin(one, list(b"stmd")), 1, np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, 0))
        at, size, room = at[size > 0], size[size > 0], room[size > 0]
        begin[at + 1] = False
        begin[(at + 1 + size)[room > 1 + size]] = True
    solid = kind != GAP
    begin &= solid
    place = np.append(0, np.cumsum(solid))
    start = np.flatnonzero(begin)
    ends = np.append(place[start], place[-1]).astype(np.int32)
    out = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])])
    return out, np.diff(np.searchsorted(start, offsets))


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    """The array, or one of at least n places that begins with it."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def newest(numbered: dict, known: int) -> list:
    """The keys that have come after the first ``known``, in order."""
    return list(islice(reversed(numbered), len(numbered) - known))[::-1]


def _parts_finely(file: dict) -> bool:
    """Whether a tokenizer's definition parts usual texts as ``pieces`` does; added tokens must not be usual."""
    steps = [{k: v for k, v in x.items() if k != "trim_offsets"} for x in (file["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return (file["normalizer"] or {}).get("normalizers") == NORMAL and steps == [SPLIT, BYTES] and all("<|" in x["content"] for x in file["added_tokens"])


class Lists:
    """Lists of ids behind each other, by number."""

    def __init__(self) -> None:
        self.first, self.size, self.ids, self.n, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32), 0, 0

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        n, used = self.n + len(size), self.used + len(ids)
        self.first, self.size, self.ids = _grown(self.first, n), _grown(self.size, n), _grown(self.ids, used)
        self.first[self.n : n] = self.used + np.cumsum(size) - size
        self.size[self.n : n] = size
        self.ids[self.used : used] = ids
        self.n, self.used = n, used

    def get(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each) of the numbered lists."""
        size = self.size[which].astype(np.int64)
        return self.ids[spans(self.first[which], size)], size


class Encoder:
    """Encodes texts piece by piece and remembers pieces.

    The tokenizer of ``path`` must drop white space and never join what white space parts;
    then a text's ids are those of its words in turn, each word's made by the library.
    Where the file says that lower-cased text is parted into contractions, letters, single digits
    and runs of signs before any merge, usual texts are parted so, and the pieces are what is encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(names.values()) + 1, bool)
        self.is_end[[i for t, i in names.items() if t.endswith("</w>")]] = True
        self.fine = _parts_finely(json.loads(self.tokenizer.to_str()))
        if self.tokenizer.encode(" a\tb\n", add_special_tokens=False).ids != self.tokenizer.encode("a b", add_special_tokens=False).ids:
            raise ValueError(f"{path} keeps white space")
        self.clear()

    def clear(self) -> None:
        # pieces get numbers as they come; the arrays hold where their ids lie
        self.pieces: dict[bytes, int] = defaultdict(count().__next__)
        self.of_pieces = Lists()

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each text) of strings without white space; those of letters only are encoded many at a time."""
        size, parts, order = np.zeros(len(texts), np.int64), [], []
        letters = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        plain, rest = np.flatnonzero(letters).tolist(), np.flatnonzero(~letters).tolist()
        groups = [plain[k : k + 400] for k in range(0, len(plain), 400)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                size[group] = np.diff(ends, prepend=0)
                parts.append(ids)
                order += group
            else:  # a letter that lower-casing takes apart
                rest += group
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            size[i] = len(ids)
            parts.append(ids)
        order = np.array(order + rest, np.int64)
        first = np.zeros(len(texts), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([*parts, np.zeros(0, np.uint32)])[spans(first, size)], size

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """The numbers of pieces; new ones are encoded."""
        known = len(self.pieces)
        which = np.fromiter(map(self.pieces.__getitem__, distinct.to_numpy(zero_copy_only=False)), np.int64, len(distinct))
        if len(self.pieces) > known:
            self.of_pieces.add(*self._library([x.decode() for x in newest(self.pieces, known)]))
        return which

    def encode(self, column: pa.Array, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each with the end id."""
        data, offsets = utf8(column)
        size = np.diff(offsets)
        odd = odd_rows(data, offsets) if self.fine else np.ones(len(size), bool)
        if odd.any():
            usual, raw = data[spans(offsets[:-1][~odd], size[~odd])], data.tobytes()
            words = [raw[offsets[i] : offsets[i + 1]].split() for i in np.flatnonzero(odd)]
        else:
            usual, words = data, []
        parts, n_usual = pieces(usual, np.append(0, np.cumsum(size[~odd])))
        parts = pa.concat_arrays([parts, pa.array(list(chain.from_iterable(words)), pa.binary())])
        n_words = np.zeros(len(size), np.int64)
        n_words[~odd] = n_usual
        n_words[odd] = [len(x) for x in words]
        if len(self.pieces) > WORDS:
            self.clear()
        coded = parts.dictionary_encode()
        which = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        if odd.any():  # back into the order of the rows
            first = np.zeros(len(size), np.int64)
            order = np.append(np.flatnonzero(~odd), np.flatnonzero(odd))
            first[order] = np.cumsum(n_words[order]) - n_words[order]
            which = which[spans(first, n_words)]
        found, size = self.of_pieces.get(which)
        before = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(n_words))]
        tail = 0 if end is None else 1
        out_offsets = before + tail * np.arange(len(before))
        out = np.empty(out_offsets[-1], np.uint32)
        if tail:
            mine = np.ones(len(out), bool)
            mine[out_offsets[1:] - 1] = False
            out[~mine] = end
            out[mine] = found
        else:
            out[:] = found
        return out, out_offsets


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget(path: str) -> None:
    """Drop the pieces that this process remembers; a task does so at its end."""
    encoder(path).clear()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def width(path: str) -> str:
    """The type in which ids of a vocabulary file are kept: two bytes where all fit, else four."""
    return "<u2" if max(encoder(path).tokenizer.get_vocab().values()) < 1 << 16 else "<u4"


def with_ids(docs: DataFrame, path: str | None = None, kind: str = "<u4") -> DataFrame:
    """(doc_id, ids): each text's ids and the end id as little-endian unsigned integers of the type ``kind``.

    Null text counts as empty; rows that share a doc_id stay apart.
    """
    path = path or default_vocabulary()
    size = int(kind[-1])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=4 << 20):
            ids, offsets = encoder(path).encode(batch.column("text"))
            data = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((size * offsets).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": data})
        forget(path)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary")
