"""Periodic runs, repeated windows and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from vgraph.llm import spelling
from vgraph.llm.arrays import U64, mix
from vgraph.llm.periodic_runs import find_runs, periodic_runs, stretches
from vgraph.llm.queries import QUERIES
from vgraph.llm.super_kmers import dedup_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def documents(sf=SF):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()


def plain_runs(x, least=12):
    """By all periods: the smallest one of each maximal stretch."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(x, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(x) if i not in gone)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_words(rng):
    k = rng.choice([1, 2, 2, 3, 6])
    x = [rng.randrange(k) for _ in range(rng.randint(0, 50))]
    if rng.random() < 0.5:
        block = [rng.randrange(k + 3) for _ in range(rng.randint(1, 12))]
        x += block * rng.randint(1, 6) + block[: rng.randint(0, len(block))] + x[: rng.randint(0, 9)]
    return x


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(1500):
        x, least = random_words(rng), rng.choice([4, 6, 12])
        expected = plain_runs(x, least)
        assert find_runs(x, least) == expected
        first, count = stretches(mix(np.array(x, U64)), np.zeros(len(x), np.int64), least, min(6, least // 2))
        assert sorted((a + s, n, q) for a, b in zip(first.tolist(), count.tolist()) for s, n, q in find_runs(x[a : a + b], least)) == expected


def test_runs_operator(spark):
    rng = random.Random(5)
    rows = [(d, "\n".join(f"wört{w}" for w in random_words(rng)), "x") for d in range(200)]
    rows += [(None, "a b " * 9, "x"), (500, None, None), (501, "", "x"), (502, " \t\n", "x"), (503, "one " * 30_000, "x"), (503, "one " * 30_000, "x"), (504, "z" * 3_000_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed_text"]) for r in periodic_runs(df).collect())
    expected = Counter()
    for d, text, _ in rows:
        x = WORD.findall(text or "")
        runs = [(0, 30_000, 1)] if d == 503 else plain_runs(x)
        expected[d, len(x), tuple(runs), collapsed(x, runs)] += 1
    assert got == expected
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, least=3)


def test_runs_query_on_the_whole_table(spark):
    expected = []
    for d, text in documents():
        x = WORD.findall(text or "")
        h, n = zlib.crc32(str(d).encode()), len(x)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(x)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        expected.append((d, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(collapsed(x, runs))))
    got = QUERIES["op11_automaton_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert sum(r[1] for r in expected) > 5


def plain_windows(rows, n):
    last = float("inf")
    first = {}
    for d, text in rows:
        x = WORD.findall(text or "")
        for i in range(len(x) - n + 1):
            w = tuple(x[i : i + n])
            first[w] = min(first.get(w, last), last if d is None else d)
    out = Counter()
    for d, text in rows:
        x = WORD.findall(text or "")
        gone = set()
        for i in range(len(x) - n + 1):
            if first[tuple(x[i : i + n])] < (last if d is None else d):
                gone.update(range(i, i + n))
        out[d, len(x), len(gone), " ".join(w for i, w in enumerate(x) if i not in gone)] += 1
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_windows_of_random_texts(spark, monkeypatch, hot):
    from vgraph.llm import super_kmers

    monkeypatch.setattr(super_kmers, "HOT", hot)
    monkeypatch.setattr(super_kmers, "_repeated", _with_bound(super_kmers, hot))
    rng = random.Random(7)
    passages = [[rng.choice("abcdé") for _ in range(rng.randint(3, 40))] for _ in range(15)]
    rows = []
    for d in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abcdefghé") for _ in range(rng.randint(0, 20))] for _ in range(rng.randint(0, 7))]
        rows.append((d, rng.choice([" ", "\n ", "\t"]).join(w for p in parts for w in p)))
    rows += [(500, None), (501, ""), (502, "x " * 300), (503, "x " * 120), (504, "a b " * 90), (504, "a b " * 90), (None, "a b " * 90), (505, "a b " * 91), (506, "x " * 12), (507, "x " * 13)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").repartition(4)
    for n in (13, 5, 2):
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in dedup_windows(df, n).collect())
        assert got == plain_windows(rows, n)
    assert dedup_windows(df.limit(0)).count() == 0


def _with_bound(module, hot):
    """The bucket's function with a bound of its own, as tasks import the module anew."""
    inner = module._repeated

    def run(table):
        from vgraph.llm import super_kmers

        super_kmers.HOT = hot
        return inner(table)

    return run


def test_windows_around_one_phrase_spread_over_shards(spark, monkeypatch):
    """A phrase of ten words amid different text: the windows of its minimisers go to many shards."""
    from vgraph.llm import super_kmers

    monkeypatch.setattr(super_kmers, "SHARD_BYTES", 40_000)
    rng = random.Random(9)
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(30)] + list("klmnopqrst") + [f"w{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(9000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dedup_windows(df).agg({"n_removed": "sum"}).first()[0]
    assert got == sum(n * c for (_, _, n, _), c in plain_windows(list(enumerate(texts)), 13).items())


def plain_spelling(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    return plain_variants({w: c for w, c in n.items() if len(w) >= 5 and c >= 3})


def plain_variants(n, ratio=2):
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :], 1].add(w)
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    near = defaultdict(set)
    for key, group in holes.items():
        for u in group:
            for v in group:
                # a shared hole, or one word with a hole that is the other word
                if u != v and (len(key) == 3 and isinstance(key, tuple) or key in (u, v)):
                    near[u].add(v)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_spelling_query_on_the_whole_table(spark):
    got = sorted((tuple(r) for r in QUERIES["op13_spelling"](spark, SF).collect()), key=str)
    assert got == plain_spelling(documents())
    assert any(r[1] for r in got)


@pytest.mark.parametrize("cell", [20_000, 4])
def test_variants_of_random_words(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))) for _ in range(900)} | {"q" * k for k in range(1, 9)} | {"präfix" + a + b for a in "abcdefgh" for b in "stuvwxyz"}
    n = {w: int(2 ** rng.uniform(0, 12)) for w in words}
    df = spark.createDataFrame([*n.items(), (None, 5), ("nothing", None)], "word string, n long")
    assert sorted((tuple(r) for r in spelling.variants(df).collect()), key=str) == plain_variants(n)
    got = sorted((tuple(r) for r in spelling.variants(df.union(df), ratio=1).select("word", "n").collect()), key=str)
    assert got == sorted(((w, 2 * c) for w, c in n.items()), key=str)
    assert spelling.variants(df.limit(0)).count() == 0


def test_letter_runs(spark):
    df = spark.createDataFrame([(1, "Hällo WÖRLD×x3y\nÀb", "q"), (2, None, None), (3, "", "")], "doc_id long, text string, word string")
    assert sorted(tuple(r) for r in spelling.letter_runs(df).collect()) == sorted([(1, "hällo"), (1, "wÖrld×x"), (1, "y"), (1, "Àb")])
