"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

Each tree splits by random directions near the medians, where fewest vectors lie within the
margin; a vector within it goes to both sides, so that close pairs rarely part. A node stays whole
where most of its vectors would go to both sides, as those of one close cluster do. Vectors are compared within
leaves only. A pair counts in the first leaf that both share and nowhere else, so links
are counted without being listed, and each leaf sends at most one edge a vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vgraph.llm.arrays import groups, lean, runs
from vgraph.operators.components import connected_components
from vgraph.plans.workspace import materialize

#: Trees, rows of a leaf aimed at (fewer for small sets, see ``leaf_size``), rows of a block in which a larger leaf is compared, and about how many
#: vectors of each length (by a hash of their ids) the splits are fitted on.
TREES, LEAF, BLOCK, FIT = 4, 400, 1500, 20_000
#: Vectors of a node that a split is fitted on at least, the share of a node that may go to both sides, and levels at most.
NODE, SPILL, LEVELS = 16, 0.5, 24
#: Large leaves up to which their sizes are sent to all tasks.
LARGE = 200_000
_SEED = 20260101


def _directions(dim: int, tree: int, depth: int) -> np.ndarray:
    """A unit vector for each inner node of a tree; node i has the children 2i + 1 and 2i + 2."""
    r = np.random.default_rng([_SEED, dim, tree]).standard_normal((2**depth - 1, dim))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def leaf_size(most: int) -> float:
    """The rows of a leaf aimed at, where the largest set of equal labels has ``most``: six times the root, up to ``LEAF``."""
    return min(LEAF, 6 * math.sqrt(most))


def _fit(unit: np.ndarray, directions: np.ndarray, depth: int, margin: float, least: float) -> np.ndarray:
    """The split of each inner node, NaN where a node stays whole, as one of up to ``least`` vectors does."""
    node, splits = np.zeros(len(unit), np.int64), np.full(len(directions), np.nan)
    for level in range(depth):
        at = np.einsum("ij,ij->i", unit, directions[node])
        order = np.lexsort((at, node))
        begin = runs(node[order])
        for a, b in zip(begin, np.append(begin[1:], len(order)), strict=True):
            n = node[order[a]]
            x = at[order[a:b]]
            if n < 2**level - 1 or len(x) <= max(NODE, least):
                continue
            tried = x[np.linspace(len(x) // 4, 3 * len(x) // 4, 33).astype(int)]
            left, right = np.searchsorted(x, tried + margin, "right"), len(x) - np.searchsorted(x, tried - margin)
            # the products that are left on both sides weigh what goes to both against even halves
            best = np.lexsort((np.abs(np.arange(33) - 16), left * left + right * right))[0]
            if left[best] + right[best] - len(x) <= SPILL * len(x):
                splits[n] = tried[best]
        split = splits[node]
        go = ~np.isnan(split)
        node = np.where(go, 2 * node + 1 + (at > split), node)
        if not go.any():
            break
    return splits


def _walk(unit: np.ndarray, directions: np.ndarray, splits: np.ndarray, depth: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all memberships."""
    row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
    done_row, done = [], []
    for _ in range(depth):
        split = splits[node]
        whole = np.isnan(split)
        done_row.append(row[whole]), done.append(node[whole])
        row, node, split = row[~whole], node[~whole], split[~whole]
        at = np.einsum("ij,ij->i", unit[row], directions[node])
        left, right = at <= split + margin, at >= split - margin
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return np.concatenate([*done_row, row]), np.concatenate([*done, node])


def _fitted(cosine: float):
    """The trees of one length of vectors, fitted on its sample."""

    def run(table: pa.Table) -> pa.Table:
        dim, most, n = (table.column(c)[0].as_py() for c in ("dim", "most", "n"))
        unit = np.stack(_vectors(table.column("embedding").combine_chunks()))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        # half as many levels more than even splits would take, as some vectors go to both sides; a node in its aim stays whole
        depth = max(0, min(LEVELS, math.ceil(1.5 * math.log2(most / leaf_size(most))) + 1, int(math.log2(len(unit) / NODE + 1)) + 1))
        margin = math.sqrt(max(0.0, 2 - 2 * cosine) / dim)
        splits = [_fit(unit, _directions(dim, t, depth), depth, margin, leaf_size(most) * len(unit) / most).tobytes() for t in range(TREES)]
        return pa.table({"dim": pa.array([dim], pa.int32()), "depth": pa.array([depth], pa.int32()), "splits": pa.array([splits], pa.list_(pa.binary()))})

    return run


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [_scaled(np.asarray(x, np.float64)) for x in column.to_numpy(zero_copy_only=False)]


def _scaled(x: np.ndarray) -> np.ndarray:
    """A vector whose squares fit double precision: a very large or small one is scaled by a power of two, which leaves cosines as they are."""
    top = np.abs(x).max(initial=0.0)
    return x if 2.0**-400 < top < 2.0**400 or not top else np.ldexp(x, -np.frexp(top)[1])


def _assign(model: dict, cosine: float, kind: str):
    """Rows by tree and leaf; each has the leaves of its vector in all trees."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dim = _vectors(batch.column("embedding")), batch.column("dim").to_numpy()
            for d in np.unique(dim):
                mine = np.flatnonzero(dim == d)
                unit = np.stack([vectors[i] for i in mine])
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                depth, splits = model.get(int(d), (0, [np.zeros(0)] * TREES))
                margin = math.sqrt(max(0.0, 2 - 2 * cosine) / d)
                row, leaf, tree = [], [], []
                for t in range(TREES):
                    r, at = _walk(unit, _directions(int(d), t, depth), splits[t], depth, margin)
                    row.append(r), leaf.append(at), tree.append(np.full(len(r), t))
                row, leaf, tree = map(np.concatenate, (row, leaf, tree))
                order = np.lexsort((leaf, tree, row))
                row, leaf, tree = row[order], leaf[order], tree[order]
                begin = np.searchsorted(row, np.arange(len(mine) + 1))
                code = (tree << 32) | leaf
                codes = [code[begin[i] : begin[i + 1]].tobytes() for i in range(len(mine))]
                at = pa.array(mine[row])
                yield pa.RecordBatch.from_pydict({"label": batch.column("label").take(at), "dim": batch.column("dim").take(at), "tree": pa.array(tree), "leaf": pa.array(leaf), "rep": batch.column("rep").take(at), "copies": batch.column("copies").take(at), "vector": pa.array([vectors[i].astype(kind).tobytes() for i in mine], pa.binary()).take(pa.array(row)), "codes": pa.array(codes, pa.binary()).take(pa.array(row))})

    return run


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of two tables of sorted codes (-1 and -2: none) the smallest that both have."""
    shared = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int64).max)
    return shared.min(1)


def _compare(cosine: float, keys: list[str], kind: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            names = [table.column(k).to_numpy() for k in keys]
            begin = np.unique(np.concatenate([runs(x) for x in names]))
            for a, b in zip(begin, np.append(begin[1:], table.num_rows), strict=True):
                if b - a > 1:
                    yield _leaf(table.slice(a, b - a), cosine, kind)

    return run


def _leaf(table: pa.Table, cosine: float, kind: str) -> pa.RecordBatch:
    rep, copies, block = (table.column(x).to_numpy() for x in ("rep", "copies", "block"))
    own = (int(table.column("tree")[0].as_py()) << 32) | int(table.column("leaf")[0].as_py())
    v = np.stack([np.frombuffer(x, kind) for x in table.column("vector").to_pylist()]).astype(np.float64)
    norm = np.linalg.norm(v, axis=1)
    codes = [np.frombuffer(x, np.int64) for x in table.column("codes").to_pylist()]
    width = max(map(len, codes))
    left = np.stack([np.pad(c, (0, width - len(c)), constant_values=-1) for c in codes])
    right = np.where(left < 0, -2, left)
    src, dst = [], []
    cross = table.column("a")[0] != table.column("b")[0]
    for at in range(0, len(v), 512):
        near = (v[at : at + 512] @ v.T) / (norm[at : at + 512, None] * norm) >= cosine
        if cross:
            near &= block[at : at + 512, None] < block
        i, j = np.nonzero(near)
        i += at
        keep = np.ones(len(i), bool) if cross else i < j
        src.append(i[keep]), dst.append(j[keep])
    src, dst = np.concatenate(src), np.concatenate(dst)
    step = max(1, 4_000_000 // (width * width))
    mine = np.concatenate([np.zeros(0, bool)] + [_first_shared(left[src[k : k + step]], right[dst[k : k + step]]) == own for k in range(0, len(src), step)])
    src, dst = src[mine], dst[mine]
    count = np.bincount(src, copies[dst], len(v)) + np.bincount(dst, copies[src], len(v))
    root = np.arange(len(v))
    while True:
        low = np.minimum(root[src], root[dst])
        new = root.copy()
        np.minimum.at(new, src, low)
        np.minimum.at(new, dst, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    full = np.flatnonzero(count)
    return pa.RecordBatch.from_pydict({"rep": pa.array(rep[full]), "root": pa.array(rep[root[full]]), "links": pa.array(count[full].astype(np.int64))})


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each vec_id of ``vectors`` (vec_id, embedding, label).

    Vectors of equal labels are linked at a cosine of at least ``cosine``, taken in double precision.
    A vector that is null, empty, zero or holds null or non-finite components, or whose label or vec_id is null,
    has no links; those of different lengths aren't compared. Rows that share a vec_id stand for
    the smallest of their (label, embedding). A null vec_id has a null component_id and kept = true.
    Equal vectors are collapsed first, so a large group of copies is compared once.

    A pair at the threshold parts in one tree with a probability of about 0.0007 a level, and in all four
    trees with one below 1e-7; closer pairs part less. The splits come from about ``FIT`` vectors of each length.
    """
    spark = vectors.sparkSession
    # single precision is kept as such; all sums are taken in double precision
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    one = vectors.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("label", F.col("embedding").cast("array<double>").alias("embedding"))).alias("x"))
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False))) & F.exists(e, lambda x: x != 0), F.lit(False))
    one = materialize(one.select("vec_id", "x.*").withColumn("good", good), "vectors")
    sets = one.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding"))
    sets = materialize(sets, "sets")
    # a row for each length of vectors
    sizes = sets.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("n")).where("most > 1")
    share = F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < F.lit(1e6 * FIT) / F.col("n")
    sample = sets.join(F.broadcast(sizes), "dim").where(share).select("dim", "most", "n", "embedding").repartition("dim")
    fitted = sample.groupBy("dim").applyInArrow(_fitted(cosine), "dim int, depth int, splits array<binary>").collect()
    model = {r["dim"]: (r["depth"], [np.frombuffer(x, np.float64) for x in r["splits"]]) for r in fitted}
    label_type = dict(sets.dtypes)["label"]
    placed = sets.mapInArrow(_assign(model, cosine, kind), f"label {label_type}, dim int, tree long, leaf long, rep long, copies long, vector binary, codes binary")
    placed = materialize(placed, "placed")
    leaf = ["label", "dim", "tree", "leaf"]
    # leaves of more than a block are dealt into blocks by a hash; each pair of blocks meets once
    large = placed.groupBy(*leaf).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).withColumn("blocks", F.floor((F.col("size") - 1) / BLOCK) + 1).drop("size")
    large = materialize(large, "large")
    sized = placed.join(F.broadcast(large) if large.count() <= LARGE else large, leaf, "left")
    sized = sized.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = sized.select("*", others).withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["key", "tree", "leaf", "a", "b"]
    dealt = dealt.withColumn("key", F.xxhash64("label", "dim")).select(*keys, "block", "rep", "copies", "vector", "codes")
    found = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "rep").mapInArrow(_compare(cosine, keys, kind), "rep long, root long, links long")
    found = materialize(found, "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found, "rep", "root").withColumnRenamed("id", "rep")
    by_set = sets.join(links, "rep", "left").join(joined, "rep", "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = one.join(by_set.withColumn("good", F.lit(True)), ["good", "label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
