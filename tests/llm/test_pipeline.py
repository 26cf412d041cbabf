"""The pipeline against plain versions of its five stages, one after the other."""

import hashlib
import math
import random
import zlib
from itertools import combinations

import corpus_pipeline
from tests.llm.brute import components, shingles
from tests.llm.test_kneser_ney import plain_model, units
from tests.llm.test_tokens import real
from vgraph.llm import kneser_ney
from vgraph.llm.packing import LENGTH

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["an", "der", "ti", "no", "st", "é"]) for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(90):
        words = [word() for _ in range(rng.randint(20, 120))]
        if i % 9 == 4:
            at = rng.randint(0, len(words))
            words[at:at] = passage.split()
        text = " ".join(words)
        if i % 10 == 7:
            text = rows[i - 1][1] if i % 20 == 7 else rows[i - 1][1] + " qu"
        if i % 15 == 11:
            text = " ".join("%$#Q" + w + "zzz" for w in words)
        rows.append((i, text, "xy"[i % 3 == 2], "abc"[min(i % 7, 2)]))
    rows += [(200, None, "x", "a"), (201, "", "x", None), (202, rows[3][1] + " no", None, None), (203, "  ", None, "b")]
    return [(i, t, x, s, None if t is None else len(t)) for i, t, x, s in rows]


def plain_quality(rows, good):
    scores = {}
    for lang in {x or "" for _, _, x, *_ in rows}:
        mine = [(i, t) for i, t, x, *_ in rows if (x or "") == lang]
        p = plain_model([t or "" for i, t in mine if i in good])
        known = any(i in good for i, _ in mine)
        for i, t in mine:
            if t:
                u = units(t)
                each = [math.log(p(tuple(u[k : k + 4]))) if known else 0.0 for k in range(len(u) - 3)]
                n = min(len(each), kneser_ney.WINDOW)
                scores[i] = lang, math.exp(-sum(each) / len(each)), math.exp(-min(sum(each[k : k + n]) / n for k in range(len(each) - n + 1)))
    keep = set()
    for i, (lang, *both) in scores.items():
        trusted = [s[1:] for k, s in scores.items() if s[0] == lang and k in good]
        limits = [sorted(x)[math.ceil(0.995 * len(x)) - 1] for x in zip(*trusted)] if trusted else [math.inf] * 2
        if all(a <= b + 1e-9 for a, b in zip(both, limits)):
            keep.add(i)
    return [r for r in rows if r[0] in keep]


def plain_dedup(rows):
    sets = {i: shingles(t, 5) for i, t, *_ in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    first = components(list(sets), links)
    return [r for r in rows if first[r[0]] == r[0]]


def plain_cut(rows):
    least, first, out = corpus_pipeline.PASSAGE, {}, []
    for i, t, *_ in rows:
        raw = t.encode()
        for k in range(len(raw) - least + 1):
            first[raw[k : k + least]] = min(i, first.get(raw[k : k + least], i))
    for i, t, x, s, _ in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - least + 1):
            if first[raw[k : k + least]] < i:
                gone[k : k + least] = bytes([1]) * least
        kept, at = "", 0
        for c in t:
            n = len(c.encode())
            kept += "" if all(gone[at : at + n]) else c
            at += n
        out.append((i, kept, x, s, len(kept)))
    return out


def plain_mix(rows):
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(t)
    full = [s for s in size if size[s]]
    out = []
    for r in rows:
        rate = sum(size.values()) / len(full) / size[r[3]] if size[r[3]] else 0.0
        point, k, c = int(hashlib.md5(f"0:{r[0]}".encode()).hexdigest()[:13], 16) / 16**13, 0, 0.0
        while rate and (c := c + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))) <= point:
            k += 1
        out += [r] * k
    return out


def test_every_stage_gives_what_its_plain_version_gives(spark, tmp_path):
    rows = documents()
    good = {r[0] for r in rows if r[0] < 90 and r[0] % 15 != 11 and r[0] % 4 != 1}
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] in good), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    key = lambda r: tuple((x is None, x) for x in r)
    plain = [lambda x: plain_quality(x, good), plain_dedup, plain_cut, plain_mix]
    sizes = []
    for (name, stage), version in zip(corpus_pipeline.STAGES, plain):
        docs, want = stage(spark, docs, str(tmp_path)), version(want)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(tuple, docs.collect()), key=key) == sorted(want, key=key), name
        sizes.append(sum(len(r[1]) for r in want))
    assert len(rows) > len(plain_quality(rows, good)) and sizes[0] > sizes[1] > sizes[2] and sizes[3] != sizes[2]
    pieces = []
    for i, t, *_ in want:
        ids = real(t)
        for at in range(0, len(ids), LENGTH):
            part = ids[at : at + LENGTH]
            pieces.append((i, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(pieces)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        ends = [0] + [a + n for a, n in sorted(held)]
        assert [a for a, _ in sorted(held)] == ends[:-1] and ends[-1] <= LENGTH


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
