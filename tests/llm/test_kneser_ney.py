import math
import random
from collections import Counter, defaultdict

from vgraph.llm import kneser_ney
from vgraph.llm.kneser_ney import quality


def units(text):
    return [1, 1, 1, *(min(ord(c), 0xFFFF) if ord(c) <= 0xFFFF else 0xFFFD for c in text), 2]


def plain_model(texts):
    """log p of each four units' last, by the formulas of interpolated modified Kneser-Ney."""
    c = {4: Counter()}
    for t in texts:
        u = units(t)
        c[4].update(tuple(u[i : i + 4]) for i in range(len(u) - 3))
    for k in (3, 2, 1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    cuts, all_, left = {}, {}, {}
    for k in c:
        n = Counter(c[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        cuts[k] = [min(i, max(0.05, i - (i + 1) * y * n[i + 1] / n[i])) if y is not None and n[i] else 0.5 * i for i in (1, 2, 3)]
        all_[k], left[k] = Counter(), defaultdict(float)
        for g, m in c[k].items():
            all_[k][g[:-1]] += m
            left[k][g[:-1]] += cuts[k][min(m, 3) - 1]

    def p(g):
        out = 1 / (len(c[1]) + 1)
        for k in range(1, 5):
            part = g[4 - k :]
            if (h := part[:-1]) in all_[k]:
                m = c[k][part]
                out = ((m - cuts[k][min(m, 3) - 1] if m else 0.0) + left[k][h] * out) / all_[k][h]
        return out

    return p


def rows_of(rng):
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(i, make("aabbc de", rng.randint(1, 80)), "x") for i in range(60)] + [(100 + i, make("éü fg", rng.randint(1, 80)), "y") for i in range(40)]
    return rows + [(200, None, "x"), (201, "", "x"), (202, "no model", "z"), (203, "漢\U0001f600", "x"), (204, "abc", None), (205, "!!" * 30000, "x"), (None, "aab", "x")]


def test_perplexity_is_that_of_a_plain_model(spark, monkeypatch):
    rows = rows_of(random.Random(3))
    df = spark.createDataFrame([(*r, "more", "own") for r in rows], "doc_id long, text string, lang string, kept string, of_lang string").repartition(4)
    good = spark.createDataFrame([(i,) for i in (*range(0, 50), *range(100, 130), 204, None)], "doc_id long")
    models = {lang: plain_model([t for i, t, x in rows if (x or "") == lang and i is not None and (i < 50 or 100 <= i < 130 or i == 204)]) for lang in ("x", "y", "")}
    for sent in (kneser_ney.SENT, 10):
        monkeypatch.setattr(kneser_ney, "SENT", sent)
        got = quality(df, good, 0.9).collect()
        assert len(got) == len(rows) and {r["of_lang"] for r in got} == {"own"}
        for r in got:
            if not r["text"]:
                assert r["perplexity"] is None and not r["kept"]
                continue
            if r["lang"] == "z":
                assert r["threshold"] is None and r["kept"]
                continue
            u = units(r["text"])
            p = models[r["lang"] or ""]
            each = [math.log(p(tuple(u[i : i + 4]))) for i in range(len(u) - 3)]
            want = math.exp(-sum(each) / len(each))
            assert abs(r["perplexity"] - want) < 1e-6 * want
            many = min(len(each), kneser_ney.WINDOW)
            want = math.exp(-min(sum(each[i : i + many]) / many for i in range(len(each) - many + 1)))
            assert abs(r["worst_perplexity"] - want) < 1e-6 * want
            assert r["kept"] == (r["perplexity"] <= r["threshold"] and r["worst_perplexity"] <= r["worst_threshold"])
    assert quality(df.limit(0), good).count() == 0


def test_bad_documents_go_and_good_ones_stay(spark):
    from vgraph.llm.queries import op8_kneser_ney

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    # toxic documents of good prose are no clean ones
    out = op8_kneser_ney(spark, d).join(labels, "doc_id").where("quality = 0 or toxic = 0").selectExpr("quality", "int(kept) kept").groupBy("quality").avg("kept").collect()
    share = {r[0]: r[1] for r in out}
    # the smallest languages have some 40 trusted documents here
    assert share[1] > 0.95 and share[0] < 0.25


def test_toxic_words_in_good_prose_show(spark):
    from vgraph.llm.queries import op8_kneser_ney

    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = op8_kneser_ney(spark, d).join(labels, "doc_id").where("lang = 'en' and quality = 1").selectExpr("toxic", "int(kept) kept").groupBy("toxic").avg("kept").collect()
    share = {r[0]: r[1] for r in out}
    assert share[1] < 0.1 and share[0] > 0.98


def test_null_is_not_the_language_of_an_empty_name(spark):
    rows = [(i, "aab abb " * 4, "") for i in range(30)] + [(100, "zq xj", None), (101, "zq xj", ""), (102, "zq xj", "=")]
    got = {r["doc_id"]: (r["kept"], r["threshold"] is None) for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.range(30).withColumnRenamed("id", "doc_id"), 0.9).collect()}
    assert (got[100], got[101], got[102]) == ((True, True), (False, False), (True, True))
