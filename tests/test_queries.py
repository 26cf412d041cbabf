from itertools import product

import duckdb
import pytest

from tests.oracle import expected, found
from vgraph.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    names, rows = found(QUERIES[name](spark, SF))
    want_names, want = expected(ORACLES[name], SF)
    assert names == want_names
    assert len(rows) == len(want)
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF if name == "compared_graphs" else "/root/testdata/sf0.001").count() > 0


def plain_voxels(sf):
    """The voxels of every order with both ends in one graph."""
    known = {r[0] for r in duckdb.sql(f"select c_custkey from '{sf}/customer.parquet'").fetchall()}
    out = set()
    for eid, src in duckdb.sql(f"select o_orderkey, o_custkey from '{sf}/orders.parquet'").fetchall():
        k = eid % 3
        dst = src + (0 if eid % 97 == 0 else (1, 12, 144)[k])
        inside = src == dst or k == 2 or (src % 12 < 11 if k == 0 else src // 12 % 12 < 11)
        if not inside or dst not in known or src // 576 != dst // 576:
            continue
        ends = [[x % 12 * 40 + 20, x // 12 % 12 * 40 + 20, x // 144 * 40 + 20] for x in (src, dst)]
        n = 2 + eid % 4
        for i in range(n):
            at = [a + (b - a) * i / (n - 1) for a, b in zip(*ends, strict=True)]
            at[2] += ((eid + i) % 3 - 1) * 2 if 0 < i < n - 1 else 0
            out.add(tuple(int(x / 4 + 0.5) for x in at))
    return out


def plain_parts(voxels):
    """Numbers of nodes, links, loops, end points and isolated points by the definition."""
    near = {v: [w for o in product((-1, 0, 1), repeat=3) if any(o) and (w := tuple(a + b for a, b in zip(v, o, strict=True))) in voxels] for v in voxels}
    kind = {v: min(len(n), 3) for v, n in near.items()}

    def groups(k):
        left, out = {v for v in voxels if kind[v] == k}, []
        while left:
            todo = [left.pop()]
            group = set(todo)
            while todo:
                new = {w for w in near[todo.pop()] if w in left}
                left -= new
                group |= new
                todo += new
            out.append(group)
        return out

    nodes, chains = groups(3), groups(2)
    loops = sum(all(kind[w] == 2 for v in c for w in near[v]) for c in chains)
    ends = [v for v in voxels if kind[v] == 1]
    contacts = sum(kind[w] == 3 or (kind[w] == 1 and v < w) for v in ends for w in near[v])
    return {"nodes": len(nodes), "links": len(chains) - loops + contacts, "loops": loops, "endpoints": len(ends), "isopoints": sum(k == 0 for k in kind.values())}


def test_skeleton_graph_holds_every_order_of_all_graphs(spark):
    want = plain_parts(plain_voxels(SF))
    assert {r["part"]: r["n"] for r in QUERIES["skeleton_graph"](spark, SF).collect()} == want
