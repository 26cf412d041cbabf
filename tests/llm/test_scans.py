import random
import re

import duckdb
from pyspark.sql import functions as F

from vgraph.llm.licenses import Scanner, TEMPLATES, differences, scan_licenses
from vgraph.llm.queries import URL_RULES
from vgraph.llm.url_rules import filter_urls, mine, tokens


def test_notices_are_found_and_told_apart(spark):
    scanner = Scanner(TEMPLATES)
    for name, texts in TEMPLATES.items():
        for text in texts:
            assert scanner.judge(text)[0] == name and scanner.judge(text)[2] == 0
    assert scanner.judge("The license of this band is its music, and all of it is loud.") is None
    assert scanner.judge("This work is licensed under the GNU General Public Licence, version 3.")[0::2] == ("GPL-3.0", 1)
    assert differences("a b c".split(), "x a q c y".split()) == 1
    broken = "Intro\nThis Source Code Form is subject to the terms\nof the Mozilla Public License,\nv. 2.0.\nMore"
    rows = [(1, "Prose.\nReleased under the MIT License.\nAll rights reserved.\n"), (2, None), (3, ""), (4, "no notice"), (4, broken), (None, "All rights reserved."), (5, "w " * 90000 + "\nLicensed under CC BY-NC 4.0.")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0, r["line"], r["license"]) for r in got)) == [(0, 0, "all-rights-reserved"), (1, 1, "MIT"), (1, 2, "all-rights-reserved"), (4, 2, "MPL-2.0"), (5, 1, "CC-BY-NC-4.0")]
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_against_plain_search(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    want = []
    for doc, text in duckdb.sql(f"select doc_id, text from '{path}'").fetchall():
        for i, line in enumerate(text.split("\n")):
            for name, texts in TEMPLATES.items():
                want += [(doc, i, name)] * (line.strip() in texts)
    got = sorted((r["doc_id"], r["line"], r["license"]) for r in scan_licenses(spark.read.parquet(path)).collect())
    assert got == sorted(want) and len(got) > 20


def test_notices_within_prose_and_beside_each_other(spark):
    prose = "The river ran past the old mill and nobody in the town minded it much. " * 3
    own = {"House": ["Take what you like and say whose it was."]}
    rows = [(k, prose[:n] + " Released under the MIT License. " + prose[: n // 2]) for k, n in enumerate((0, 20, 40, 200))]
    rows += [(4, f"{prose}we say it is Released under the MIT License. All rights reserved. {prose}Licensed under CC BY-SA 4.0."), (5, "All rights reserved. Released under the MIT License.\nLicensed under\nCC BY 4.0."), (6, prose)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(k, 0, "MIT") for k in range(5)] + [(4, 0, "all-rights-reserved"), (4, 0, "CC-BY-SA-4.0"), (5, 0, "all-rights-reserved"), (5, 0, "MIT"), (5, 1, "CC-BY-4.0")]
    assert sorted((r["doc_id"], r["line"], r["license"]) for r in got) == sorted(want)
    mine = spark.createDataFrame([(1, f"{prose}Take what you like and say whose it was. {prose}"), (2, prose)], "doc_id long, text string")
    assert [(r["doc_id"], r["license"]) for r in scan_licenses(mine, own).collect()] == [(1, "House")]


def test_other_licenses_and_denials_are_no_notices(spark):
    none = ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "This work is licensed under a Creative Commons Attribution 3.0 International License.", "This work is licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU General Public License, version 1.", "This work is not licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 1.1.", "It is not released under the MIT License.", "Never licensed under CC BY 4.0."]
    got = scan_licenses(spark.createDataFrame(list(enumerate(none)), "doc_id long, text string")).collect()
    assert got == []
    fine = ["que no\nReleased under the MIT License.", "I think not. Released under the MIT License."]
    assert [r["license"] for r in scan_licenses(spark.createDataFrame(list(enumerate(fine)), "doc_id long, text string")).collect()] == ["MIT"] * 2
    shared = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    assert [r["license"] for r in scan_licenses(spark.createDataFrame([(1, shared)], "doc_id long, text string")).collect()] == ["BSD-2-Clause OR BSD-3-Clause"]


def test_short_forms_other_spellings_and_denials_far_off(spark):
    said = [("Released under the MIT Licence.", "MIT"), ("It is available under the MIT License, as is the rest.", "MIT"), ("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("Licensed under the GNU GPL v3", "GPL-3.0"), ("x\n  The MIT License\n\nCopyright", "MIT"), ("(MIT License)", "MIT"), ("It is not new, but it is licensed under CC BY 4.0.", "CC-BY-4.0"), ("Distributed under the Apache Licence 2.0", "Apache-2.0")]
    none = ["It is not in any way licensed under CC BY 4.0.", "Nothing here is licensed under the MIT License.", "It was formerly released under the MIT License.", "Released under the MIT License, which no longer holds.", "We like the MIT License for what it says", "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the GNU GPL v1", "Released under the ISC License."]
    rows = list(enumerate([t for t, _ in said] + none))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(k, name) for k, (_, name) in enumerate(said)]


def plain_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_and_mined_rules(spark):
    rng = random.Random(5)
    bad = lambda: f"http://{rng.choice('ab')}.{rng.choice(['spam', 'pills'])}.com/{rng.choice(['x', 'y'])}/{rng.randint(0, 999)}"
    good = lambda: f"https://{rng.choice('abc')}.{rng.choice(['news', 'wiki', 'spam'])}.com/{rng.choice(['z', 'y'])}/{rng.randint(0, 999)}"
    labelled = [(bad(), True) for _ in range(400)] + [(good(), False) for _ in range(400)] + [(None, True), ("x", None), ("no scheme", True)]
    train = spark.createDataFrame(labelled, "url string, block boolean")
    rules = mine(train, 0.01, 0.7).collect()
    sets = [(set(r[0]), b) for r, (u, b) in zip(train.select(tokens(F.col("url"))).collect(), labelled, strict=True) if u and b is not None and r[0]]
    assert rules
    for r in rules:
        held = [b for s, b in sets if set(r["items"]) <= s]
        assert abs(sum(held) / len(held) - r["confidence"]) < 1e-9 and r["confidence"] >= 0.7 and sum(held) >= 0.01 * len(sets) - 1e-9
    odd = [None, "", "no scheme", "://", "HTTP://A.Example.NET/en/1", "http://net/", "http://net", "http://x.net?q=/", "http://xnet/", "http://e.example.com/de/", "http://o.org/fr/#x", "http://u@h.org:80/fr/?a=b", "http://a.net/\n#z", "x://y://z.net/de/", "http://É.org/fr/"]
    pages = [(i, u, "kept") for i, u in enumerate(odd + [bad() for _ in range(50)] + [good() for _ in range(50)])] + [(3, "://", "again"), (None, "://", "null")]
    got = filter_urls(spark.createDataFrame(pages, "page_id long, url string, host string"), train, URL_RULES, 0.01, 0.7).collect()
    assert len(got) == len(pages)
    items = spark.createDataFrame([(u,) for _, u, _ in pages], "url string").select("url", tokens(F.col("url"))).collect()
    for url, found in items:
        hit = any(set(r["items"]) <= set(found) for r in rules)
        host, path, rule, verdict = plain_rule(url)
        for r in (r for r in got if r["url"] == url):
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or ("block" if hit else "allow")), url
    assert mine(train.limit(0)).count() == 0


def test_a_rare_host_is_found_in_a_large_table_and_chance_is_not_in_a_small_one(spark):
    url = "concat('http://', {}, '/', id % 7, '/', id)"
    large = spark.range(60_000).selectExpr("if(id < 60, " + url.format("'rare-pills.biz'") + ", " + url.format("concat('site', id % 50, '.org')") + ") as url", "id < 60 or id % 10 = 0 as block")
    assert ["host1:rare-pills"] in [r["items"] for r in mine(large).where("size(items) = 1").collect()] or ["host0:biz"] in [r["items"] for r in mine(large).collect()]
    small = spark.range(900).selectExpr(url.format("concat('site', id div 3, '.org')") + " as url", "hash(id) % 10 = 0 as block")
    assert mine(small).count() == 0
