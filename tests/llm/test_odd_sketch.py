import random
from itertools import combinations

import duckdb

from tests.llm.brute import components, shingles
from vgraph.llm import odd_sketch
from vgraph.llm.odd_sketch import near_duplicates


def check(spark, rows, n):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, n).collect()}
    sets = {d: shingles(t, n) for d, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(list(sets), links)
    assert got == {d: (len(s), comp[d], comp[d] == d) for d, s in sets.items()}
    assert any(c != d for d, c in comp.items())


def copies(rng, n_groups, size):
    rows, doc = [], 0
    for _ in range(n_groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 150))]
        for _ in range(rng.randint(1, size)):
            text = [w if rng.random() > 0.04 else f"v{rng.randint(0, 9999)}" for w in base]
            rows.append((doc, rng.choice([" ", "\n"]).join(text)))
            doc += 1
    rows += [(doc, None), (doc + 1, ""), (doc + 2, " \t\n"), (doc + 3, "One"), (doc + 4, "oNE"), (doc + 5, "é x")]
    rng.shuffle(rows)
    return rows


def test_near_copies(spark):
    check(spark, copies(random.Random(2), 40, 9), 2)
    check(spark, copies(random.Random(3), 30, 9), 5)


def test_large_clusters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(odd_sketch, "BLOCK", 6)
    monkeypatch.setattr(odd_sketch, "HOT", 20)
    rows = copies(random.Random(4), 5, 60)
    check(spark, rows, 2)
    monkeypatch.setattr(odd_sketch, "SENT", 0)
    check(spark, rows + [(1000 + i, "the same few words") for i in range(50)], 2)


def test_whole_table(spark):
    check(spark, duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall(), 2)


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept int")
    assert near_duplicates(df).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, 2).collect()), key=str) == [(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True)]
