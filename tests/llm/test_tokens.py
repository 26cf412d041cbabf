import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vgraph.llm.mixing import mix_sources
from vgraph.llm.packing import LENGTH, SLACK, fill, pack, plan, slots
from vgraph.llm.tokens import Encoder, default_vocabulary
from vgraph.llm.vbyte import decode, encode, new_folder, read_ids, write_ids

LIBRARY = Tokenizer.from_file(default_vocabulary())
ODD = ["", None, " \t\r\n\x0b\x0c ", "á b c d ́x", "<|endoftext|> it's <|endoftext|>x don't'LL", "x" * 5000, "é\x85ü \x1c\x1d y", "​ ﻿ 漢字かな\U0001f600 12ab34 ...--- \x00 z", "word " * 30000, "İstanbul ΑΣ. ΑΣ.α ǅa ﬁx Σ Ça, ÇA! é, a's. B.C.", "((x)) x) ..y. it's, 'tis A--B", "TARİHİ. İ. ŞEHRİ, Aİ!"]


def real(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def test_words_give_the_ids_of_whole_texts():
    import duckdb

    texts = ODD + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    ids, offsets = Encoder(default_vocabulary()).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == real(t), t


def test_random_strings_give_the_ids_of_the_library():
    rng = random.Random(5)
    usual = ["a", "B", "z", "s", "t", "re", "VE", "ll", "m", "d", "'", "'s", "'RE", "''", " ", "  ", "\n", "\t", "\x0b\r", "1", "23", ".", ",", "!?", '"', "<", "|>", "é", "É", "ß", "Ÿ", "ǅ", "Ⱥ", "ſ", "_", "-"]
    other = ["\x1c", "\x7f", "<|", "<|endoftext|>", "İ", "TARİHİ.", "×", "÷", "²", "½", "\u00a0", "\x85", "«", "¿", "ª", "µ", "ɐ", "漢", "\U0001f600", "Σ", "ς", "\u0301", "\u212a", "\u200b", "—", "’s"]
    texts = ["".join(rng.choice(usual + other if i % 3 == 0 else usual) for _ in range(rng.randint(0, 14))) for i in range(20_000)]
    ids, offsets = Encoder(default_vocabulary()).encode(pa.array(texts, pa.string()))
    for i, found in enumerate(LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*found.ids, 2], texts[i]


def test_variable_bytes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        ranks = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = encode(ranks)
        assert (decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def rows_of(n):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randint(0, 999)}" for _ in range(int(10 ** rng.uniform(0, 3.8))))) for i in range(n)]
    return rows + [(n + i, t) for i, t in enumerate(ODD)]


def test_written_ids_come_back_in_order(spark):
    rows = rows_of(60)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(read_ids(spark, write_ids(df, new_folder(spark))).collect())
    at = 0
    for r, (doc, text) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = np.array(real(text), "<u4").tobytes()
        assert tuple(r) == (doc, at, len(ids) // 4, zlib.crc32(ids), bytearray(ids))
        at += len(ids) // 4
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert read_ids(spark, write_ids(empty, new_folder(spark))).count() == 0


def test_packs_hold_each_id_once(spark):
    rows = rows_of(300) + [(5, "twice"), (5, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = pack(df).collect()
    sequences = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= LENGTH
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(len(real(t)) for _, t in rows)
    assert sum(r["length"] for r in got) == total
    # no plan of whole pieces does much better than this
    assert len(sequences) <= -(-total // LENGTH) * 1.05 + 1
    docs = defaultdict(list)
    for r in got:
        if r["doc_id"] not in (5, None):
            docs[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    for doc, text in rows:
        if doc in docs:
            assert b"".join(x for _, x in sorted(docs[doc])) == np.array(real(text), "<u4").tobytes()
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_places_every_piece():
    rng = random.Random(3)
    for most in (16, 4096):
        histogram = {rng.randint(1, most): rng.randint(1, 50_000) for _ in range(300)}
        placed = defaultdict(int)
        for packs, pattern in plan(histogram, most):
            assert sum(a * n for a, n in pattern) <= most and packs > 0
            for a, n in pattern:
                placed[a] += packs * n
        assert placed == histogram


def test_filled_plans_pad_little_for_any_lengths():
    rng = random.Random(4)
    hostile = [{n: rng.randint(1, 3000) for n in range(2100, 2701)}, {1365: 1_000_000, 1366: 1_000_000}, {2049: 1_000_003}, {4000: 17, 2500: 10, 1: 12}, {1500: 7, 3: 1}, {4096: 5}, {1: 10_000}, {3000: 1, 2000: 1}, {}]
    hostile += [{rng.randint(1, 4096): rng.randint(1, 50_000) for _ in range(rng.randint(1, 40))} for _ in range(60)]
    for most, histogram in [(4096, h) for h in hostile] + [(16, {rng.randint(1, 16): rng.randint(1, 90) for _ in range(5)}) for _ in range(200)]:
        filled = fill(plan(histogram, most), most)
        total, packs = sum(k * n for k, n in histogram.items()), sum(p for p, _, _ in filled)
        assert all(p > 0 and sum(k * n for k, n in pattern) + sum(b - a for _, _, a, b in parts) <= most for p, pattern, parts in filled)
        assert packs * most - total < most + (most // SLACK) * packs
        # each id of each piece has one place
        for length, rows in slots(filled).items():
            edges = sorted({*rows[:, 0].tolist(), *rows[:, 1].tolist()})
            assert edges[0] == 0 and edges[-1] == histogram[length]
            for low in edges[:-1]:
                mine = sorted((a, b) for first, end, a, b, *_ in rows.tolist() if first <= low < end)
                assert mine[0][0] == 0 and mine[-1][1] == length and all(x[1] == y[0] for x, y in zip(mine, mine[1:], strict=False))


def test_pieces_are_cut_to_fill_sequences(spark):
    rows = [(i, "word " * (32 + i % 9)) for i in range(500)] + [(7, "word " * 33)] * 2 + [(None, "word " * 150), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = pack(df, most=64).collect()
    want = sorted(real(t) for _, t in rows)
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    for parts in sequences.values():
        ends = [0, *(a + n for a, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64
    total = sum(map(len, want))
    assert sorted(sequences) == list(range(len(sequences))) and len(sequences) * 64 - total < 64 + len(sequences)
    assert len(got) > len(rows) + 50
    for doc, text in rows:
        if doc not in (7, None):
            parts = sorted(docs[doc])
            assert [x for _, ids, _ in parts for x in ids] == real(text) and {n for *_, n in parts} == {len(real(text))}
            assert [a for a, *_ in parts] == [sum(len(x) for _, x, _ in parts[:k]) for k in range(len(parts))]
    for doc in (7, None):
        assert sum(len(x) for _, x, _ in docs[doc]) == sum(len(real(t)) for d, t in rows if d == doc)
    plain = pack(df, most=64, with_ids=False)
    assert "ids" not in plain.columns
    key = lambda r: (r["sequence_id"], r["offset"], r["doc_id"] or -1, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert sorted(map(key, plain.collect())) == sorted(map(key, got))


def test_mixing_reaches_its_targets(spark):
    rows = [(i, "x" * 10, "big" if i % 4 else "small") for i in range(8000)] + [(9000, "y", None), (9001, None, "none"), (9002, "", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    out = mix_sources(df, weights).collect()
    size = {s: sum(len(r["text"] or "") for r in out if r["source"] == s) for s in ("big", "small", None)}
    assert size[None] == 0 and abs(size["big"] - 40000) < 2000 and abs(size["small"] - 40000) < 3000
    assert len({(r["doc_id"], r["copy"]) for r in out}) == len(out)
    assert [r["position"] for r in out] == sorted(r["position"] for r in out)
    assert mix_sources(df.limit(0)).count() == 0


def test_mixing_keeps_columns_of_any_name_and_adds_repeated_weights(spark):
    df = spark.createDataFrame([(i, "x" * 10, "ab"[i % 2], i, i, i) for i in range(400)], "doc_id long, text string, source string, sums long, times long, first long")
    twice = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 1.0)], "source string, weight double")
    out = mix_sources(df, twice).collect()
    assert all(r["doc_id"] == r["sums"] == r["times"] == r["first"] for r in out) and {r["rate"] for r in out} == {1.0}
    assert len({(r["doc_id"], r["copy"]) for r in out}) == len(out) > 300


def test_rare_sources_are_repeated_as_often_as_they_need(spark):
    def drawn(rate, doc):
        point, k, c = int(hashlib.md5(f"0:{doc}".encode()).hexdigest()[:13], 16) / 16**13, 0, 0.0
        while (c := c + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))) <= point:
            k += 1
        return k

    # rates of 0.5, 300, 1,500 and 60,000
    rows = [(i, "x" * 1000, "big") for i in range(240)] + [(1000 + i, "y" * 40, "rare") for i in range(2)] + [(2000, "z" * 200, "some"), (2001, "z" * 200, "some"), (3000, "w" * 2, None)]
    weights = spark.createDataFrame([("big", 1.0), ("rare", 1.0), ("some", 1.0), (None, 1.0)], "source string, weight double")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df, weights, total=480_000.0).groupBy("doc_id", "rate").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("m"), F.max("copy").alias("last")).collect()
    got = {r["doc_id"]: r["n"] for r in out}
    assert {round(r["rate"], 6) for r in out} == {0.5, 300.0, 1500.0, 60000.0}
    assert all(r["n"] == r["m"] == r["last"] + 1 for r in out)
    of = {"big": 0.5, "some": 300.0, "rare": 1500.0, None: 60000.0}
    assert got == {i: n for i, _, s in rows if (n := drawn(of[s], i))}
