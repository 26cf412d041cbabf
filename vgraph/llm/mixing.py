"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

Each document is repeated as often as an inverted Poisson distribution says at a
point drawn from a hash of its id and a seed, with its source's target repetition rate as the
mean; copies are then put into an order given by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vgraph.plans.workspace import materialize

#: Digits of an MD5 that make a point between 0 and 1: 13 hexadecimal digits are 52 bits.
DIGITS = 13
#: Sources and probabilities up to which their table is sent to all tasks; beyond, documents are dealt by source.
MOST_SENT, MOST_SUMS = 50_000, 20_000_000
#: Means up to which exp() gives the probability of 0, with which the table begins; those of larger means begin near the mean.
FROM_ZERO = 500
#: Copies of a document that are held at once.
BLOCK = 10_000


def uniform(text: Column) -> Column:
    """A point in [0, 1) by a hash of the text."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def poisson_table(rate: Column) -> Column:
    """The cumulative probabilities of 0, 1, ... for a mean, up to where doubles no longer tell them from 1."""
    # the mean and twelve deviations, and 40 more for small means
    last = F.least(F.lit(100_000), F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int"))
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * rate / k)).alias("sums"))
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["sums"])


def near_mean(rate: Column, k: Column) -> Column:
    """The probability of k, some hundreds at least, for a mean near it: Stirling's series, and the rest by the share that k differs by."""
    x = (k - rate) / rate
    series = 1 / (12 * k) - 1 / (360 * F.pow(k, F.lit(3.0))) + 1 / (1260 * F.pow(k, F.lit(5.0)))
    return F.exp(-rate * ((1 + x) * F.log1p(x) - x) - series) / F.sqrt(2 * math.pi * k)


def tables(rated: DataFrame) -> DataFrame:
    """(__mix_source, rate, __mix_first, __mix_sums): ``__mix_sums`` are the cumulative probabilities of that first number of copies, one more, ... copies."""
    columns = ["__mix_source", "rate", "__mix_first", "__mix_sums"]
    small = rated.where(F.col("rate") <= FROM_ZERO).withColumn("__mix_first", F.lit(0).cast("long")).withColumn("__mix_sums", poisson_table(F.col("rate")))
    # a point of 52 bits is never further from the mean than nine deviations and a little
    reach = F.ceil(9 * F.sqrt("rate") + 40)
    large = rated.where(F.col("rate") > FROM_ZERO).withColumns({"__mix_first": F.floor("rate") - reach, "last": F.floor("rate") + reach})
    large = large.select("__mix_source", "rate", "__mix_first", F.explode(F.sequence("__mix_first", "last")).alias("k"))
    large = large.withColumn("c", F.sum(near_mean(F.col("rate"), F.col("k").cast("double"))).over(Window.partitionBy("__mix_source").orderBy("k")))
    large = large.groupBy("__mix_source", "rate", "__mix_first").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]).alias("__mix_sums"))
    return small.select(columns).unionByName(large.select(columns))


def rates(docs: DataFrame, weights: DataFrame | None, source: str, total: float | None) -> DataFrame:
    """(source, rate): target share of the total over the source's own size in characters.

    A source that holds no characters has the rate 0. Weights that are negative or not finite stop the run.
    """
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    sizes = docs.groupBy(F.col(source).alias("__mix_source")).agg(F.sum(size).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, 1.0).otherwise(0.0))
    else:
        weights = weights.groupBy(F.col("source").alias("named")).agg(F.sum(F.col("weight").cast("double")).alias("weight"), F.min(F.col("weight").cast("double")).alias("least"))
        sizes = sizes.join(weights, F.col("__mix_source").eqNullSafe(F.col("named")), "left")
        sizes = sizes.select("__mix_source", "size", F.coalesce(F.when(F.col("least") < 0, F.col("least")).otherwise(F.col("weight")), F.lit(0.0)).alias("weight"))
    sizes = materialize(sizes, "sizes")
    row = sizes.agg(F.sum("size"), F.sum(F.when(F.col("size") > 0, F.col("weight")))).first()
    goal, shares = float(total or row[0] or 0), float(row[1] or 0)
    rate = F.when((F.col("size") > 0) & F.lit(shares > 0), F.col("weight") / (shares or 1.0) * F.lit(goal) / F.col("size")).otherwise(0.0)
    out = sizes.withColumn("rate", rate)
    worst = out.agg(F.max("rate"), F.min("weight")).first()
    if worst[0] is not None and not (worst[1] >= 0 and math.isfinite(worst[0])):
        raise ValueError(f"a source would be repeated {worst[0]} times, or a weight is {worst[1]}")
    return out.select("__mix_source", "rate")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", seed: int = 0, total: float | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, more), each as often as drawn, with rate, copy and position added.

    ``weights`` (source, weight) holds relative target shares of characters; None gives all sources with text the same share.
    A source that isn't named has none; the weights of one that is named repeatedly add up. ``total`` is the expected number of characters of the result,
    by default that of ``docs``. ``copy`` counts a document's repetitions from 0; ``position`` is a hash of 128 bits by which the
    result is sorted, so sources are spread evenly over its files. Rows with the same doc_id, null included, are drawn alike.
    A null source is a source of its own; documents of null or empty text take their source's rate.
    Columns of ``docs`` with the added names are replaced.
    """
    docs = docs.select([docs[c] for c in docs.columns if c not in ("rate", "copy", "position")])
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    table = materialize(tables(rates(docs, weights, source, total)), "sums")
    point = uniform(F.concat(F.lit(f"{seed}:"), named))
    many, long = table.agg(F.count("*"), F.coalesce(F.sum(F.size("__mix_sums")), F.lit(0))).first()
    if many <= MOST_SENT and long <= MOST_SUMS:
        table = F.broadcast(table)
    drawn = docs.join(table, F.col(source).eqNullSafe(F.col("__mix_source")))
    drawn = drawn.withColumn("__mix_times", F.col("__mix_first") + F.size(F.filter("__mix_sums", lambda c: c <= point))).drop("__mix_first", "__mix_sums")
    copies = drawn.where("__mix_times > 0").withColumn("__mix_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__mix_times - 1) div {BLOCK}"))))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("__mix_block") * BLOCK, F.least("__mix_times", (F.col("__mix_block") + 1) * BLOCK) - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), named, F.col("copy").cast("string"))).alias("position")
    copies = copies.select(*docs.columns, "rate", "copy", key)
    return copies.orderBy("position")


#: The registered query in DuckDB's SQL: all sources with the same share.
ORACLE = """
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source),
rated AS (SELECT source, (1.0 / (SELECT count(*) FROM sizes WHERE size > 0)) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes WHERE size > 0),
steps AS (SELECT source, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 60)::BIGINT)) AS k FROM rated),
parts AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM steps),
sums AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM parts),
points AS (SELECT doc_id, source, n_chars, lang, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
times AS (SELECT p.doc_id, p.source, p.lang, p.n_chars, count(*) FILTER (s.c <= p.u) AS n FROM points p JOIN sums s ON p.source IS NOT DISTINCT FROM s.source GROUP BY ALL),
copies AS (SELECT doc_id, source, lang, n_chars, unnest(range(0, n)) AS copy FROM times WHERE n > 0)
SELECT c.doc_id, d.text, c.lang, c.source, c.n_chars, c.copy, md5('order 0:' || coalesce(c.doc_id::VARCHAR, 'null') || ':' || c.copy) AS position
FROM copies c JOIN (SELECT DISTINCT doc_id, text FROM documents) d USING (doc_id)
"""
