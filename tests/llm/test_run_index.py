import random

import duckdb
import pyarrow as pa
import pytest

from tests.llm.brute import repeats
from vgraph.llm import run_index
from vgraph.llm.run_index import remove_repeats

COLS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def same(spark, rows, least):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in remove_repeats(df, least).select(COLS).collect())
    assert got == sorted(repeats(rows, least))


def with_bound(bound):
    """The bucket's function with a bound of its own, as tasks import the module anew."""
    inner = run_index._repeated

    def run(table):
        from vgraph.llm import run_index

        run_index.HOT = bound
        return inner(table)

    return run


@pytest.mark.parametrize("hot", [4096, 2])
def test_random_texts_with_shared_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(run_index, "_repeated", with_bound(hot))
    rng = random.Random(1)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 160))) for _ in range(12)]
    rows = []
    for d in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
        rows.append((d, "".join(parts)))
    rows += [(500, None), (501, ""), (502, "x" * 300), (503, "x" * 120), (504, "ab" * 90), (504, "ab" * 90), (505, "ab" * 90), (506, "x" * 49), (507, "x" * 50)]
    rng.shuffle(rows)
    same(spark, rows, 50)
    same(spark, rows, 20)


def test_whole_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
    same(spark, rows, 50)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_bytes string, block int")
    assert remove_repeats(df).count() == 0
    df = spark.createDataFrame([(1, "q" * 60, "a", 3), (2, "q" * 60 + "é", "b", 4)], df.schema)
    got = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    assert got[2]["kept_text"] == "é" and got[2]["block"] == 4 and got[2]["n_bytes"] == 62


def test_long_texts_of_one_letter(spark):
    n = 1_000_000
    df = spark.createDataFrame([(1, "a" * n), (2, "b" + "a" * n), (3, "ab" * n), (4, "ab" * n + "c")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(df, texts=False).collect()}
    assert got == {1: 0, 2: n, 3: 0, 4: 2 * n}


def test_one_phrase_amid_different_text_fills_no_shard():
    """A phrase of 40 bytes in every text: its contexts all differ, and are dealt over all shards."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = lambda n: "".join(rng.choices(letters, k=n))
    phrase = some(40).upper()
    for n in (6000, 12000):
        docs = pa.record_batch({"doc_id": pa.array(range(n)), "text": [some(120) + phrase + some(120) for _ in range(n)]})
        blocks = pa.record_batch({"block": [1, 2], "docs": [run_index._pack(docs.slice(0, n // 2)), run_index._pack(docs.slice(n // 2))]})
        requests = pa.Table.from_batches(run_index._requests(50, 1).__wrapped__([blocks]))
        found = run_index._repeated(requests)
        wanted = [{"hashes": h, "hot": x} for h, x in zip(found.column("hashes").to_pylist(), found.column("hot").to_pylist())]
        assert any(w["hot"] for w in wanted)
        c = run_index.Contexts(docs, wanted, 50)
        sizes = [int(c.length[a:b].sum()) for cut in [run_index._deal(c.hash, 40)] for a, b in zip(cut[:-1], cut[1:])]
        assert len(c.hash) > n
        assert max(sizes) < 1.5 * sum(sizes) / len(sizes)
