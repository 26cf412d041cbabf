import hashlib
import zlib

import numpy as np

from vgraph.llm import webp
from vgraph.llm.webp import decode_many, decode_webp, encode_many, padded, read, store


def pack_bits(fields):
    bits = "".join(f"{v:0{n}b}"[::-1] if isinstance(v, int) else v for v, n in fields if n)
    raw = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
    body = b"VP8L" + len(raw).to_bytes(4, "little") + raw + b"\0" * (len(raw) & 1)
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


def simple(*symbols):
    """A simple prefix code of one or two symbols."""
    return [(1, 1), (len(symbols) - 1, 1), (1, 1), (symbols[0], 8), *((s, 8) for s in symbols[1:])]


def start(w, h):
    return [(0x2F, 8), (w - 1, 14), (h - 1, 14), (0, 1), (0, 3)]


def test_stored_payloads_come_back_both_ways():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 575, 576, 577, 4000)] + [b"the text " * 500, b"\xff" * 2000, "é漢".encode() * 999]
    data, offsets = padded(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    files = encode_many(data, offsets)
    for i, (f, got) in enumerate(zip(files, decode_many(files), strict=True)):
        want = data[offsets[i] : offsets[i + 1]]
        assert (got == want).all() and len(got) == len(want)
        assert (decode_webp(f)[..., [1, 0, 2]].reshape(-1) == want).all()
        assert (decode_webp(f)[..., 3] == 255).all()


def test_back_references_and_colour_cache():
    # two pixels, a copy of six at distance two, then the cached first colour
    green = [0] * 282
    for s, n in ((7, 2), (9, 2), (260, 2), (280, 3), (281, 3)):
        green[s] = n
    first = 255 << 24 | 1 << 16 | 7 << 8 | 3
    slot = (0x1E35A7BD * first & 0xFFFFFFFF) >> 31
    codes = {}
    code = 0
    for n in (2, 3):
        code <<= 1
        for s in range(282):
            if green[s] == n:
                codes[s] = f"{code:0{n}b}"
                code += 1
    lengths = [(0, 1), (15, 4)]
    kinds = (0, 2, 3, 18)
    lengths += [(2 if s in kinds else 0, 3) for s in webp.CODE_ORDER] + [(0, 1)]
    word = {s: f"{i:02b}" for i, s in enumerate(kinds)}
    s = 0
    while s < 282:
        run = 0
        while s + run < 282 and green[s + run] == 0:
            run += 1
        if run >= 11:
            n = min(run, 138)
            lengths += [(word[18], 1), (n - 11, 7)]
            s += n
        else:
            lengths.append((word[green[s]], 1))
            s += 1
    fields = start(3, 3) + [(0, 1), (1, 1), (1, 4), (0, 1)] + lengths + simple(1) + simple(3) + simple(255) + simple(13)
    # length 6 is symbol 260 and one more bit; distance code 122 is plain distance 2, symbol 13 and five bits
    fields += [(codes[7], 1), (codes[9], 1), (codes[260], 1), (1, 1), (122 - 97, 5), (codes[280 + slot], 1)]
    image = decode_webp(pack_bits(fields))
    assert image[..., 1].ravel().tolist() == [7, 9, 7, 9, 7, 9, 7, 9, 7]
    assert (image[..., 0] == 1).all() and (image[..., 2] == 3).all()


def test_transforms_are_inverted():
    plain = [(0, 1)]  # no colour cache
    one = lambda *c: plain + [x for s in c for x in simple(s)] + simple(0)
    # predictor 1 (left): with a residue of one in green, green counts up
    fields = start(4, 2) + [(1, 1), (0, 2), (0, 3)] + one(1, 0, 0, 0) + [(0, 1)] + plain + [(0, 1)] + simple(1) + simple(0) * 3 + simple(0)
    assert decode_webp(pack_bits(fields))[..., 1].tolist() == [[1, 2, 3, 4], [2, 3, 4, 5]]
    # cross-colour: green 64 adds 64 * 32 >> 5 to red; subtract-green adds green to red and blue
    fields = start(1, 1) + [(1, 1), (1, 2), (0, 3)] + one(0, 0, 32, 255) + [(0, 1)] + plain + [(0, 1)] + simple(64) + simple(5) + simple(6) + simple(255) + simple(0)
    assert decode_webp(pack_bits(fields)).ravel().tolist() == [69, 64, 6, 255]
    fields = start(1, 1) + [(1, 1), (2, 2), (0, 1)] + plain + [(0, 1)] + simple(64) + simple(5) + simple(6) + simple(255) + simple(0)
    assert decode_webp(pack_bits(fields)).ravel().tolist() == [69, 64, 70, 255]
    # palette of two colours, eight pixels in a byte
    palette = plain + simple(10, 20) + simple(0) + simple(0) + simple(255, 0) + simple(0)
    # the codes of a simple code are by symbol: green 10 is 0, 20 is 1; alpha 0 is 0, 255 is 1
    palette += [("0", 1), ("1", 1), ("1", 1), ("0", 1)]
    fields = start(8, 1) + [(1, 1), (3, 2), (1, 8)] + palette + [(0, 1)] + plain + [(0, 1)] + simple(0b10110010) + simple(0) * 3 + simple(0)
    assert decode_webp(pack_bits(fields))[0, :, 1].tolist() == [10, 30, 10, 10, 30, 30, 10, 30]


def test_every_predictor_mode():
    rng = np.random.default_rng(1)
    res = rng.integers(0, 2**32, (5, 6), dtype=np.uint32)
    for mode in range(14):
        got = webp._channels(webp._predict(res, np.full((2, 2), mode), 2))
        assert got.shape == (5, 6, 4)
        y, x = 3, 4
        left, top, corner, right = got[y, x - 1], got[y - 1, x], got[y - 1, x - 1], got[y - 1, x + 1]
        half = lambda a, b: (a + b) // 2
        m = half(left, top)
        select = left if sum(abs(top - corner)) < sum(abs(left - corner)) else top
        want = [np.array([255, 0, 0, 0]), left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top), half(corner, top), half(top, right), half(half(left, corner), half(top, right)), select, np.clip(left + top - corner, 0, 255), np.clip(m + np.fix((m - corner) / 2).astype(int), 0, 255)][mode]
        assert (got[y, x] == (webp._channels(res[y, x]) + want) % 256).all(), mode


def test_whole_table_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "x"), (900000, None), (900001, ""), (900002, ""), (900003, "z" * 3_000_00)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in read(store(docs)).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        raw = (text or "").encode()
        raw += b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[doc]
        assert bytes(r["payload"]) == raw and r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["tail_crc32"] == zlib.crc32(raw[-32:])
    assert got[900000]["media_sha256"] == got[900001]["media_sha256"]
    assert read(store(docs.limit(0))).count() == 0


def test_runs_are_references_and_read_in_step(monkeypatch):
    rng = np.random.default_rng(4)
    payloads = [b"z" * 300_096, b"abc" * 192 * 40, bytes(rng.integers(0, 256, 576 * 3, dtype=np.uint8))]
    payloads += [(b"".join(bytes(rng.integers(97, 101, 3, dtype=np.uint8)) * int(rng.integers(1, 9)) for _ in range(400)) + b"\xff" * 576)[: 576 * 4] for _ in range(20)]
    data = np.frombuffer(b"".join(payloads), np.uint8)
    files = webp.encode_many(data, np.cumsum([0, *map(len, payloads)]))
    assert len(files[0]) < 800 and len(files[1]) < 500 and all(len(f) < len(p) for f, p in zip(files[3:], payloads[3:]))
    for f, p in zip(files, payloads, strict=True):
        assert decode_webp(f)[..., [1, 0, 2]].tobytes() == p
    monkeypatch.setattr(webp, "decode_webp", None)  # the reader in step needs no other
    assert [x.tobytes() for x in webp.decode_many(files)] == payloads
    monkeypatch.undo()
    broken = bytearray(files[1])
    broken[-6:] = b"\xff" * 6
    try:
        webp.decode_many([bytes(broken)])
    except ValueError:
        pass


def test_codes_are_fitted_and_references_reach_far(monkeypatch):
    rng = np.random.default_rng(6)
    letters = bytes(rng.choice(np.frombuffer(b"abcdefgh", np.uint8), 576 * 10))
    noise = bytes(rng.integers(0, 256, 576 * 10, dtype=np.uint8))
    grey = bytes(np.repeat(rng.integers(0, 256, 576 * 10 // 3, dtype=np.uint8), 3))
    few = bytes(rng.integers(0, 256, (40, 3), dtype=np.uint8)[rng.integers(0, 40, 192 * 10)])
    payloads = [letters, noise + noise[3 * 50 :] + b"\xff" * 150, grey, few, b"z" * 576, noise[:576]]
    files = webp.encode_many(np.frombuffer(b"".join(payloads), np.uint8), np.cumsum([0, *map(len, payloads)]))
    # three bits a letter; noise once; a third of the grey; under six bits a pixel of forty colours and their list
    for f, most in zip(files, (576 * 10 * 3 / 8 + 150, 576 * 10 + 600, 576 * 10 / 3 + 400, 192 * 10 * 6 / 8 + 500), strict=False):
        assert len(f) < most
    for f, p in zip(files, payloads, strict=True):
        assert decode_webp(f)[..., [1, 0, 2]].tobytes() == p
    monkeypatch.setattr(webp, "decode_webp", None)  # the reader in step needs no other
    assert [x.tobytes() for x in webp.decode_many(files)] == payloads
    alone = [webp.encode_many(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0] for p in payloads]
    assert alone == files


def test_fitted_codes_are_complete_and_near_huffman_codes():
    import heapq

    rng = np.random.default_rng(7)
    hist = np.stack([rng.permutation((rng.pareto(a, 200) * 20).astype(np.int64)) for a in (1.5, 2.0, 3.0, 4.0)] + [np.eye(1, 200, k, dtype=np.int64)[0] * 9 for k in (0, 7)] + [np.zeros(200, np.int64)])
    lengths = webp._fit(hist, 11)
    for h, lens in zip(hist, lengths, strict=True):
        if (h > 0).sum() < 2:
            assert lens.sum() == 1 and lens[h.argmax()] == 1
            continue
        assert ((lens > 0) == (h > 0)).all() and sum(2.0 ** -lens[lens > 0]) == 1
        heap, best = [int(x) for x in h if x], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            best += both
            heapq.heappush(heap, both)
        assert (h * lens).sum() <= 1.02 * best
