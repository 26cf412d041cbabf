"""Runs of periodic words, found with a suffix automaton whose paths are recoloured word by word.

Each state of the automaton's link tree has a colour: the last place where its
strings ended. When word i comes in, the path from the state of the whole prefix to
the root is accessed as in a link-cut tree: its segments of one colour are met
bottom up and take the colour i. A segment of colour j whose deepest string has
L words says that the words up to i and up to j agree in L words and no more. With
d = i - j <= L there is a square of period d, whose stretch begins at
i - L - d + 1; it is met again at each place of its run, so the last one is
the run's end. As j is the last place, d is the stretch's smallest period.

The automaton is built for a stretch first, so its tree stands still, and the
preferred paths are stacks of segments along heavy paths instead of splay
trees: an access meets O(log n) heavy paths, and each segment that it
pushes is popped once.

A run has its first six words again one period on, so each of its words lies in six
words that occur twice in the run. Only stretches covered by such words go to an automaton;
repeats of hashes stand in for those of words there, which can only add stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vgraph.llm.arrays import U64, chunks, joined, lean, mix, seeds, utf8, word_ids, words

#: The shortest run; words that must repeat, at most half of it.
LEAST, GRAM = 12, 6


def automaton(x: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, length of the longest string) of each state of the suffix automaton of x, and the states of x's prefixes."""
    moves: list[dict[int, int]] = [{}]
    link, length, prefix = [-1], [0], []
    last = 0
    for i, c in enumerate(x):
        new = len(moves)
        moves.append({})
        length.append(i + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        prefix.append(new)
        last = new
    return link, length, prefix


def _heavy(link: list[int], length: list[int]) -> list[int]:
    """The top state of each state's heavy path in the tree of links."""
    order = np.argsort(np.array(length), kind="stable").tolist()
    size = [1] * len(link)
    heavy = [-1] * len(link)
    most = [0] * len(link)
    for v in reversed(order[1:]):
        up = link[v]
        size[up] += size[v]
        if size[v] > most[up]:
            most[up], heavy[up] = size[v], v
    top = list(range(len(link)))
    for v in order[1:]:
        if heavy[link[v]] == v:
            top[v] = top[link[v]]
    return top


def find_runs(x: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of each maximal stretch of x of at least ``least`` words and two periods, in order."""
    link, length, prefix = automaton(x)
    top = _heavy(link, length)
    # by heavy path its coloured segments, the one nearest to the root last: (length of the deepest string, colour)
    paths: dict[int, list[tuple[int, int]]] = {}
    end: dict[tuple[int, int], int] = {}
    for i, v in enumerate(prefix):
        newest = -1
        while v > 0:
            depth, head = length[v], top[v]
            path = paths.setdefault(head, [])
            before = newest
            while path:
                deep, j = path[-1]
                size = deep if deep <= depth else depth
                # a colour that a deeper path has too was met there with its longest string
                if j > before:
                    if j > newest:
                        newest = j
                    if i - j <= size:
                        end[i - size - (i - j) + 1, i - j] = i
                if deep > depth:
                    break
                path.pop()
            path.append((depth, i))
            v = link[head]
    return sorted((s, e - s + 1, d) for (s, d), e in end.items() if e - s + 1 >= max(least, 2 * d))


def _covered(word: np.ndarray, part: np.ndarray, gram: int) -> np.ndarray:
    """Which words lie in ``gram`` words in a row that occur twice in their part."""
    many = max(len(word) - gram + 1, 0)
    h = np.zeros(many, U64)
    for j, factor in enumerate(seeds(gram, 23) | U64(1)):
        h += word[j : j + many] * factor
    whole = np.flatnonzero(part[:many] == part[gram - 1 : gram - 1 + many])
    h = mix(mix(h[whole]) + part[whole].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    starts = np.zeros(len(word) + 1, np.int64)
    np.add.at(starts, whole[again], 1)
    np.add.at(starts, whole[again] + gram, -1)
    return np.cumsum(starts)[:-1] > 0


def stretches(word: np.ndarray, row: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of the stretches that can hold runs: words are left out until all that is left repeats within its own stretch."""
    at, part = np.arange(len(word)), row
    while True:
        keep = _covered(word[at], part, gram)
        at, part = at[keep], part[keep]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        long = np.repeat(count >= least, count)
        if keep.all() and long.all():
            return at[first], count
        at, part = at[long], np.repeat(np.arange(len(first)), count)[long]


def _run(schema: pa.Schema, least: int):
    gram = min(GRAM, least // 2)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = utf8(batch.column("text"))
            start, end, row = words(data, offsets)
            word, _ = word_ids(data, start, end)
            head = np.searchsorted(row, np.arange(batch.num_rows + 1))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            gone = np.zeros(len(word) + 1, np.int64)
            for first, count in zip(*(x.tolist() for x in stretches(mix(word.astype(U64)), row, least, gram)), strict=True):
                d = int(row[first])
                for s, size, period in find_runs(word[first : first + count].tolist(), least):
                    found[d].append({"start": first + s - int(head[d]), "length": size, "period": period})
                    gone[first + s + period] += 1
                    gone[first + s + size] -= 1
            kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            own = {"n_words": np.diff(head), "runs": found, "collapsed_text": joined(data, start[kept], end[kept], row[kept], batch.num_rows)}
            columns = [own[f.name] if f.name in own else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` (text, more) with the runs of their words and their text without repeats.

    Words are numbered from 0. A run is a stretch of words with smallest period q, of at least
    ``least`` (4 or more) and 2 q words, that no neighbouring word extends. Added are n_words, ``runs`` (start,
    length, period) in that order, and ``collapsed_text``: the words, joined by one space, that no
    run contains after its first q ones. Columns of ``docs`` with these names are replaced. Null text has no words;
    nothing is shuffled, and rows are worked on one by one, so repeated ones get equal values.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if least < 4:
        raise ValueError("least must be 4 words or more")
    new = StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string")
    docs = docs.select([docs[c] for c in docs.columns if c not in new.names]).withColumn("text", docs["text"].cast("string"))
    schema = StructType([*docs.schema, *new])
    return docs.mapInArrow(_run(to_arrow_schema(schema), least), schema)
