import math
import random
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np

from tests.llm.brute import components
from vgraph.llm import rp_forest
from vgraph.llm.rp_forest import near_vectors


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = sorted(tuple(r) for r in near_vectors(df).collect())
    unit = {}
    for i, e, label in rows:
        v = None if e is None or any(x is None for x in e) else np.array(e, np.float32).astype(float)
        ok = v is not None and label is not None and len(v) and np.isfinite(v).all() and v.any()
        unit[i] = (label, len(v), v / np.linalg.norm(v)) if ok else None
    good = [i for i in unit if unit[i]]
    links = [(a, b) for a, b in combinations(good, 2) if unit[a][:2] == unit[b][:2] and unit[a][2] @ unit[b][2] >= 0.98]
    comp = components(list(unit), links)
    n = {i: sum(i in p for p in links) for i in unit}
    assert got == sorted((i, n[i], comp[i], comp[i] == i) for i in unit)
    return len(links)


def test_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "LEAF", 20)
    monkeypatch.setattr(rp_forest, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12) if g else 70):
            noise = rng.standard_normal(16) * rng.choice([0, 0.08, 0.15, 0.2])
            rows.append((len(rows), [float(x) for x in base + noise], int(rng.integers(0, 3))))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [1.0, None], 1), (n + 4, [float("nan")] * 16, 1), (n + 5, [float("inf")] * 16, 1), (n + 6, rows[0][1], None), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0), (n + 9, [3.0], 0)]
    random.Random(1).shuffle(rows)
    assert check(spark, rows) > 100


def test_whole_table(spark):
    rows = duckdb.sql("select vec_id, embedding, label from '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    check(spark, [(i, list(e), x) for i, e, x in rows])
    largest = max(n for n in Counter(x for _, _, x in rows).values())
    assert largest > rp_forest.leaf_size(largest)  # so that its trees split


def test_splits_leave_a_close_cluster_whole_and_the_rest_in_leaves():
    rng = np.random.default_rng(3)
    unit = np.concatenate([rng.standard_normal((2000, 64)), rng.standard_normal(64) + 0.01 * rng.standard_normal((2000, 64))])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    margin, depth = math.sqrt(0.04 / 64), 8
    directions = rp_forest._directions(64, 0, depth)
    splits = rp_forest._fit(unit, directions, depth, margin, 48)
    row, leaf = rp_forest._walk(unit, directions, splits, depth, margin)
    close = row >= 2000
    assert close.sum() <= 3 * 2000 and (~close).sum() <= 4 * 2000
    of = np.unique(leaf[~close], return_counts=True)[1]
    assert np.median(of) < 100


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_very_large_and_small_components(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(8)
    rows = [(k, [float(x) for x in base * scale], 1) for k, scale in enumerate((1.0, 1e200, 1e-200, -1e300, 1e-300))] + [(9, [1e308] * 8, 1), (10, [5e-324] + [0.0] * 7, 1), (11, [1.0] + [0.0] * 7, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 4: (3, 0), 3: (0, 3), 9: (0, 9), 10: (1, 10), 11: (1, 10)}
