"""A MAT file written here gives the network of the same tables."""

import random
import struct
import zlib

import pytest

from vgraph.sources import mat, voxel_graph


def element(kind, body, order="<"):
    return struct.pack(f"{order}II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def small(kind, body, order="<"):
    return struct.pack(f"{order}I", len(body) << 16 | kind) + body + b"\0" * (4 - len(body))


def matrix(kind, dims, name, content, order="<"):
    flags = element(6, struct.pack(f"{order}II", kind, 0), order)
    tag = small(1, name.encode(), order) if 0 < len(name) <= 4 else element(1, name.encode(), order)
    return element(14, flags + element(5, struct.pack(f"{order}{len(dims)}i", *dims), order) + tag + content, order)


def doubles(name, dims, values, order="<"):
    return matrix(6, dims, name, element(9, struct.pack(f"{order}{len(values)}d", *values), order), order)


def uint16s(name, dims, values, order="<"):  # numbers may be stored smaller than their class
    return matrix(6, dims, name, element(4, struct.pack(f"{order}{len(values)}H", *values), order), order)


def cells(name, items, order="<"):
    return matrix(1, (len(items), 1), name, b"".join(doubles("", (len(x), 1), x, order) for x in items), order)


def structure(name, fields, order="<"):
    names = b"".join(f.encode().ljust(32, b"\0") for f in fields)
    return matrix(2, (1, 1), name, small(5, struct.pack(f"{order}i", 32), order) + element(1, names, order) + b"".join(fields.values()), order)


def sparse(name, n, values, order="<"):
    rows = sorted(values)
    body = element(5, struct.pack(f"{order}{len(rows)}i", *(r - 1 for r in rows)), order) + element(5, struct.pack(f"{order}2i", 0, len(rows)), order)
    return matrix(5, (n, 1), name, body + element(9, struct.pack(f"{order}{len(rows)}d", *(values[r] for r in rows)), order), order)


def write(path, variables, order="<", packed=True):
    mark = b"IM" if order == "<" else b"MI"
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(f"{order}H", 0x0100) + mark
    pack = lambda v: struct.pack(f"{order}II", 15, len(z := zlib.compress(v))) + z if packed else v
    path.write_bytes(head + b"".join(map(pack, variables)))


@pytest.mark.parametrize(("order", "packed", "chunk"), [("<", True, 100_000), (">", False, 3)])
def test_network_of_a_mat_file(spark, tmp_path, monkeypatch, order, packed, chunk):
    monkeypatch.setattr(mat, "CHUNK", chunk)
    rng = random.Random(5)
    size, n = (9, 8, 7), 9 * 8 * 7
    node = [rng.sample(range(1, n + 1), rng.randint(1, 4)) for _ in range(6)]
    link = [rng.sample(range(1, n + 1), rng.randint(1, 9)) for _ in range(10)]
    ends = [(rng.randint(0, 6), rng.randint(0, 6)) for _ in link]
    radius = {i: rng.uniform(1, 9) for i in range(1, n + 1) if rng.random() < 0.9}
    label = {i: float(rng.randint(1, 3)) for i in range(1, n + 1) if rng.random() < 0.9}
    o = {"order": order}
    variables = [
        structure("num", {"mask_size": uint16s("", (1, 3), size, **o)}, **o),
        structure("node", {"cc_ind": cells("", node, **o), "num_cc": doubles("", (1, 1), [6.0], **o)}, **o),
        structure("link", {"connected_node_label": uint16s("", (len(link), 2), [a for a, _ in ends] + [b for _, b in ends], **o), "cc_ind": cells("", link, **o)}, **o),
        sparse("radius", n, radius, **o),
        sparse("label", n, label, **o),
        matrix(4, (1, 2), "text", element(4, struct.pack(f"{order}2H", 65, 66), order), order),
        doubles("no", (0, 0), [], **o),
    ]
    write(tmp_path / "graph.mat", variables, order, packed)
    path = str(tmp_path / "graph.mat")
    rows = mat.read(spark, path)
    assert rows.rdd.getNumPartitions() == len(variables)
    vertices, edges, mask = mat.load(spark, path, "g")
    assert mask == size
    table = lambda x: spark.createDataFrame(list(x.items()), "idx long, value double")
    v = voxel_graph.nodes(spark.createDataFrame([(k + 1, c) for k, c in enumerate(node)], "label long, cc array<long>"), table(radius), size, "g")
    e = voxel_graph.links(spark.createDataFrame([(k + 1, c, *ends[k]) for k, c in enumerate(link)], "link long, cc array<long>, src long, dst long"), table(radius), table(label), size, "g")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(vertices, v) and vertices.count() == 6
    assert same(edges, voxel_graph.closed(v, e))


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.mat").write_bytes(b"MATLAB 7.3 MAT-file".ljust(124) + struct.pack("<H", 0x0200) + b"IM")
    with pytest.raises(Exception, match="level 5"):
        mat.read(spark, str(tmp_path / "x.mat")).count()
