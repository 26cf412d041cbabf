"""Spelling variants: words one edit apart, by composing acceptors.

The vocabulary is dealt into cells, so that every two words one edit apart meet in a
cell: of words of m and m + 1 letters those with one first half, as what comes
after it holds the edit, and those with one second half. A cell of more than ``CELL``
words is halved in the same way again, until its words differ in one letter at most.

A bucket holds many cells. Its words become one minimised acceptor with an initial
state for each cell; states of equal futures are shared over all of them. Each state knows the
number of words from it on, so that a path's sum is its word's number. The acceptor
is composed with a transducer of exactly one edit and with itself again: pairs of
states that no edit parted yet stand for one state, the edit is a replaced or an inserted
letter, and after it both sides read the same letters. What both sides accept are the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vgraph.llm.arrays import give_back, spans
from vgraph.plans.workspace import materialize

#: Words in a cell (more than 126 letters can make in two places) and in a bucket.
CELL, BUCKET = 20_000, 40_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, word): every maximal run of Latin letters in ``text``, A to Z lower-cased; null text has none."""
    word = F.col("word")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("word"))
    return found.withColumn("word", F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER)))


def vocabulary(found: DataFrame, letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of at least so many letters that occur at least so often; counted in tasks before the shuffle."""
    counted = found.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


class Acceptor:
    """The minimised acceptor of words in cells, given in order, with an initial state for each cell."""

    def __init__(self, cells: list[int], texts: list[str]):
        self.final: list[bool] = []
        moves: list[dict[str, int]] = []
        known: dict[tuple, int] = {}
        path: list[tuple[bool, dict[str, int]]] = []

        def settle(node: tuple[bool, dict[str, int]]) -> int:
            key = (node[0], *node[1].items())
            if key not in known:
                known[key] = len(moves)
                self.final.append(node[0])
                moves.append(node[1])
            return known[key]

        def close(depth: int, last: str) -> None:
            while len(path) > depth + 1:
                state = settle(path.pop())
                path[-1][1][last[len(path) - 1]] = state

        initial, last, cell = [], "", None
        for c, text in zip(cells, texts, strict=True):
            if c != cell:
                if path:
                    close(0, last)
                    initial.append(settle(path.pop()))
                path, last, cell = [(False, {})], "", c
            common = 0
            while common < len(last) and common < len(text) and last[common] == text[common]:
                common += 1
            close(common, last)
            path.extend((False, {}) for _ in range(len(text) - common))
            path[-1] = (True, path[-1][1])
            last = text
        if path:
            close(0, last)
            initial.append(settle(path.pop()))
        self.initial = np.array(initial, np.int64)
        self.final_at = np.array(self.final, bool)
        # moves by state and letter, with the number of words that come before; a state is numbered after those it leads to
        self.head = np.append(0, np.cumsum([len(m) for m in moves])).astype(np.int64)
        self.letter = np.array([ord(c) for m in moves for c in m], np.int64)
        self.target = np.array([t for m in moves for t in m.values()], np.int64)
        words, before = [0] * len(moves), []
        for s, m in enumerate(moves):
            n = int(self.final[s])
            for t in m.values():
                before.append(n)
                n += words[t]
            words[s] = n
        self.before = np.array(before, np.int64)
        self.words = np.array(words, np.int64)
        self.key = np.repeat(np.arange(len(moves)), np.diff(self.head)) << 21 | self.letter

    def out(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the given states, move) for all moves from them."""
        n = self.head[states + 1] - self.head[states]
        return np.repeat(np.arange(len(states)), n), spans(self.head[states], n)


def one_edit_pairs(a: Acceptor) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all two words of a cell that are one edit apart, each two once; words are numbered as they were given."""
    state, word = a.initial, np.append(0, np.cumsum(a.words[a.initial])[:-1]).astype(np.int64)
    left, right, x, y = (np.zeros(0, np.int64) for _ in range(4))
    one, two = [], []
    while len(state) or len(left):
        both = a.final_at[left] & a.final_at[right]
        one.append(x[both])
        two.append(y[both])
        # the same letter on both sides after the edit
        of, move = a.out(left)
        key = right[of] << 21 | a.letter[move]
        at = np.minimum(np.searchsorted(a.key, key), max(len(a.key) - 1, 0))
        hit = a.key[at] == key if len(a.key) else np.zeros(len(key), bool)
        of, move, at = of[hit], move[hit], at[hit]
        parts = [(a.target[move], a.target[at], x[of] + a.before[move], y[of] + a.before[at])]
        # the edit: an inserted letter, with nothing read on the left, or two different letters
        of, move = a.out(state)
        ahead, number = a.target[move], word[of] + a.before[move]
        here = (state[of], ahead, word[of], number)
        n = np.bincount(of, minlength=len(state))
        rest = np.repeat(np.cumsum(n), n) - np.arange(len(of)) - 1
        first = np.repeat(np.arange(len(of)), rest)
        second = spans(np.arange(len(of)) + 1, rest)
        parts.append((ahead[first], ahead[second], number[first], number[second]))
        # an inserted letter's pair stands before the next letters as well: it is met with them in the next round
        left, right, x, y = (np.concatenate(p) for p in zip(*parts, here, strict=True))
        state, word = ahead, number
    x, y = np.concatenate(one), np.concatenate(two)
    pair = np.unique(np.minimum(x, y) << 31 | np.maximum(x, y))
    return pair >> 31, pair & (1 << 31) - 1


def _bucket(table: pa.Table) -> pa.Table:
    """(word, near, near_n): both directions of the pairs of a bucket's cells."""
    word, m, a, b, n = (table.column(c).to_pylist() for c in ("word", "m", "a", "b", "n"))
    # (length, parts that the cell's words share, and what is left of the word)
    rows = sorted((m[i], a[i], b[i], w[: a[i]], w[len(w) - b[i] :], w[a[i] : len(w) - b[i]], i) for i, w in enumerate(word))
    cells, cell, last = [], -1, None
    for r in rows:
        if r[:5] != last:
            cell, last = cell + 1, r[:5]
        cells.append(cell)
    x, y = one_edit_pairs(Acceptor(cells, [r[5] for r in rows]))
    place, length = np.array([r[6] for r in rows]), np.array([len(r[5]) - r[0] + r[1] + r[2] for r in rows])
    # two words of m + 1 letters meet in a cell of their own as well
    own = (length[x] == 0) | (length[y] == 0)
    x, y = place[x[own]], place[y[own]]
    words, counts = table.column("word").combine_chunks(), np.array(n, np.int64)
    give_back()
    return pa.table({"word": words.take(pa.array(np.append(x, y))), "near": words.take(pa.array(np.append(y, x))), "near_n": pa.array(counts[np.append(y, x)])})


def cells(vocab: DataFrame) -> DataFrame:
    """(word, n, m, a, b): the cells that each word is in, told by m and the word's first a and last b letters."""
    size = F.length("word")
    kinds = F.array(*(F.struct((size - d).alias("m"), F.floor((size - d) / 2).cast("int").alias("h"), F.lit(front).alias("front")) for d in (0, 1) for front in (True, False)))
    c = vocab.select("word", "n", F.explode(kinds).alias("k")).where("k.m >= 1")
    out = materialize(c.select("word", "n", F.col("k.m").alias("m"), F.when(F.col("k.front"), F.col("k.h")).otherwise(0).alias("a"), F.when(F.col("k.front"), 0).otherwise(F.col("k.m") - F.col("k.h")).alias("b")), "cells")
    keys = ["m", "a", "b", "front", "back"]
    while True:
        named = out.withColumns(parts())
        large = named.groupBy(keys).count().where((F.col("count") > CELL) & (F.col("m") - F.col("a") - F.col("b") > 1)).drop("count")
        large = materialize(large, "large")
        if large.isEmpty():
            return out
        r = F.col("m") - F.col("a") - F.col("b")
        split = named.join(large, keys).withColumn("q", F.floor(r / 2).cast("int")).drop("front", "back")
        halves = split.withColumn("a", F.col("a") + F.col("q")).drop("q").unionByName(split.withColumn("b", F.col("b") + r - F.col("q")).drop("q"))
        out = materialize(named.join(large, keys, "left_anti").drop("front", "back").unionByName(halves), "cells")


def parts() -> dict:
    """The letters that the words of a cell share at their front and back."""
    return {"front": F.left("word", F.col("a")), "back": F.when(F.col("b") > 0, F.right("word", F.col("b"))).otherwise("")}


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, near, near_n): all words of the vocabulary (word, n) one edit apart, in both directions, each once and dealt by word."""
    c = cells(vocab)
    buckets = c.count() // BUCKET + 1
    dealt = c.withColumns(parts()).withColumn("bucket", F.pmod(F.xxhash64("m", "a", "b", "front", "back"), F.lit(buckets))).drop("front", "back")
    pairs = dealt.groupBy("bucket").applyInArrow(_bucket, "word string, near string, near_n long")
    # an inserted letter beside its like is met in two cells
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def variants(vocab: DataFrame, ratio: int = 2) -> DataFrame:
    """The vocabulary (word, n) with each word's form, root, n_near and form_n.

    Words are near that differ by one inserted, deleted or replaced code point. The form is the near word
    of largest n (ties: the smallest) if that n is at least ``ratio`` times the word's; else null, as is form_n. The root
    is found from the word over forms to the last. Words of a null n or null words are left out; a word should stand once
    (repeated rows count with their sum). Chains are followed by doubling: as n grows by ``ratio`` a step, there
    are some log log n rounds. With a ratio below 2 they end when nothing moves.
    """
    vocab = materialize(vocab.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    best = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    joined = vocab.join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    out = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    out = materialize(out, "forms")
    up = materialize(out.where("form is not null").select("word", F.col("form").alias("up"), F.lit(True).alias("moved")), "up")
    while not up.where("moved").isEmpty():
        more = up.select(F.col("word").alias("up"), F.col("up").alias("next"))
        up = materialize(up.join(more, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "up")
    return out.join(up.select("word", F.col("up").alias("root")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
