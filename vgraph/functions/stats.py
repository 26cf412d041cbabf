"""Group tests and distributions."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vgraph.plans.workspace import materialize
from vgraph.schema import finite

#: Parts that a range is counted in, rows of a range that are looked at themselves, rows of a range of running sums.
BINS, FEW, RANGE = 4096, 4096, 200_000


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + k * d
            c = 1.0 + k / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def student_p(t: float, df: float) -> float:
    """The two-sided probability of a t statistic."""
    if not (math.isfinite(df) and df > 0) or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def t_probability(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else student_p(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null."""
    return left.join(right.withColumnsRenamed({k: f"__{k}" for k in keys}), reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.lit(True)), how).drop(*(f"__{k}" for k in keys))


def percentiles(df: DataFrame, value: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """By keys: the exact percentiles of a value, in columns of the given names, interpolated between neighbours.

    Nulls and non-finite values are left out, as are groups without others. Ranks are found by refining histograms: in each pass a range
    that holds a rank is counted in ``BINS`` equal parts, of which the one with the rank is the next range, until it has ``FEW`` rows or one
    value. Those are looked at themselves, so no task holds more than counts and so many values, and there are two or
    three passes over a group of any usual size. ``df`` should be a table, as each pass reads it.
    """
    x = df.select(*by, finite(F.col(value).cast("double")).alias("__x")).where("__x is not null")
    start = x.groupBy(*by).agg(F.count("*").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high"))
    places = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("place")) for name, p in at.items()))
    ranks = start.select(*by, "n", "low", "high", F.explode(places).alias("p")).select(*by, "n", "low", "high", "p.*").withColumn("rank", F.floor("place"))
    # as the ranks are read again, the first state need not be written
    ranks = materialize(ranks.withColumn("part", F.col("place") - F.col("rank")), "ranks")
    need = ranks.select(*by, "low", "high", F.col("n").alias("size"), F.explode(F.array("rank", F.least(F.col("rank") + 1, F.col("n") - 1))).alias("rank")).distinct()
    state = need.withColumn("before", F.lit(0).cast("long"))
    keys = [*by, "low", "high"]
    wide = (F.col("size") > FEW) & (F.col("low") < F.col("high"))

    def within(ranges: DataFrame) -> DataFrame:
        r = ranges.withColumnsRenamed({k: f"__{k}" for k in by})
        on = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"__{k}")), by, F.col("__x").between(F.col("low"), F.col("high")))
        return x.join(r, on).drop(*(f"__{k}" for k in by))

    while not (open_ := state.where(wide)).isEmpty():
        # monotone in the value, whatever is lost in rounding
        low, high, v = F.col("low"), F.col("high"), F.col("__x")
        share = F.when(high - low < math.inf, (v - low) / (high - low)).otherwise((v / 2 - low / 2) / (high / 2 - low / 2))
        part = F.least(F.floor(share * BINS), F.lit(BINS - 1))
        bins = within(open_.select(*keys).distinct()).groupBy(*keys, part.alias("bin")).agg(F.count("*").alias("n"), F.min("__x").alias("low2"), F.max("__x").alias("high2"))
        # a range has BINS rows here
        bins = bins.withColumn("past", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("n"))
        found = joined(open_.drop("size"), bins, keys).where((F.col("rank") - F.col("before") >= F.col("past")) & (F.col("rank") - F.col("before") < F.col("past") + F.col("n")))
        found = found.select(*by, F.col("low2").alias("low"), F.col("high2").alias("high"), F.col("n").alias("size"), "rank", (F.col("before") + F.col("past")).alias("before"))
        state = materialize(state.where(~wide).unionByName(found), "state")
    several = state.where("low < high")
    held = within(several.select(*keys).distinct()).groupBy(*keys).agg(F.sort_array(F.collect_list("__x")).alias("xs"))
    got = joined(several, held, keys).select(*by, "rank", F.get("xs", (F.col("rank") - F.col("before")).cast("int")).alias("v"))
    got = got.unionByName(state.where("low >= high").select(*by, "rank", F.col("low").alias("v")))
    # a percentile lies at or between two of the ranks
    near = joined(ranks, got.withColumnRenamed("rank", "r"), by).where((F.col("r") == F.col("rank")) | ((F.col("r") == F.col("rank") + 1) & (F.col("part") > 0)))
    pair = near.groupBy(*by, "name").agg(F.sum(F.when(F.col("r") == F.col("rank"), (1 - F.col("part")) * F.col("v")).otherwise(F.col("part") * F.col("v"))).alias("v"))
    return pair.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in at))


def running(df: DataFrame, by: list[str], value: str, columns: list[str]) -> DataFrame:
    """``df`` with sum_<c> of each column over the rows of its group up to the value, and all_<c> over all of them.

    Rows are dealt by ranges of keys and values. Sums run within a range and over the totals of the ranges before, so a group of any
    size is worked on by many tasks. Values should stand once in a group.
    """
    rows = materialize(df, "rows")
    ranges = rows.count() // RANGE + 1
    dealt = materialize(rows.repartitionByRange(ranges, *by, value).withColumn("__range", F.spark_partition_id()), "dealt")
    run = Window.partitionBy(*by, "__range").orderBy(value)
    # one row for each range that a group is in
    over = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "__range").agg(*(F.sum(c).alias(c) for c in columns))
    totals = totals.select(*by, "__range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in columns), *(F.sum(c).over(over).alias(f"all_{c}") for c in columns))
    out = joined(dealt, totals, [*by, "__range"])
    return out.select(*df.columns, *((F.sum(c).over(run) + F.col(f"__before_{c}")).alias(f"sum_{c}") for c in columns), *(f"all_{c}" for c in columns))


def _moments(df: DataFrame, keys: list[str], value: str, medians: bool = True) -> DataFrame:
    # nulls are left to the aggregates: a filter would be pushed down and repeat whatever the value is computed by
    x = df.select(*keys, finite(F.col(value)).alias("__x"))
    x = materialize(x, "values") if medians else x
    out = x.groupBy(*keys).agg(F.count("__x").alias("n"), F.avg("__x").alias("mean"), F.var_samp("__x").alias("var")).where("n > 0")
    return joined(out, percentiles(x, "__x", keys, {"median": 0.5}), keys) if medians else out.withColumn("median", F.lit(None).cast("double"))


def welch(df: DataFrame, value: str, group: str, order: list[str], by: list[str] | None = None, p: bool = True, medians: bool = True) -> DataFrame:
    """Welch's t test of every pair of groups, in the given order, by further keys; NULL where a group has under two values.

    Without ``medians`` those are null and their passes are saved.
    """
    by = by or []
    m = _moments(df.where(F.col(group).isin(order)), [*by, group], value, medians)
    place = F.array_position(F.array(*(F.lit(g) for g in order)), F.col(group))
    names = [group, "n", "mean", "var", "median"]
    # at most one row for each named group meets here
    rows = m.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), *names))).alias("rows"))
    j = rows.select(*by, "rows", F.explode("rows").alias("a")).select(*by, "a", F.explode("rows").alias("b")).where("a.place < b.place")
    j = j.select(*by, *(F.col(f"{side}.{c}").alias(f"{c}{i}") for side, i in (("a", 1), ("b", 2)) for c in names))
    s1, s2 = (F.when((F.col("n1") > 1) & (F.col("n2") > 1), F.col(f"var{i}") / F.col(f"n{i}")) for i in (1, 2))
    t = (F.col("mean1") - F.col("mean2")) / F.nullif(F.sqrt(s1 + s2), F.lit(0.0))
    df_ = F.pow(s1 + s2, F.lit(2.0)) / F.nullif(s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1), F.lit(0.0))
    out = j.select(*by, f"{group}1", f"{group}2", "n1", "n2", "mean1", "mean2", "median1", "median2", t.alias("t"), df_.alias("df"))
    return out.withColumn("p", t_probability("t", "df")) if p else out


def paired_t(df: DataFrame, delta: str, by: list[str], p: bool = True) -> DataFrame:
    """The paired t test of differences against zero; NULL for under two."""
    m = _moments(df, by, delta)
    t = F.when(F.col("n") > 1, F.col("mean") / F.nullif(F.sqrt(F.col("var") / F.col("n")), F.lit(0.0)))
    out = m.select(*by, "n", F.col("mean").alias("mean_delta"), F.col("median").alias("median_delta"), t.alias("t"), (F.col("n") - 1).cast("double").alias("df"))
    return out.withColumn("p", t_probability("t", "df")) if p else out


def ks(df: DataFrame, value: str, group: str, first: str, second: str, by: list[str] | None = None) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov distance and its asymptotic probability, by further keys.

    Equal values are counted first and their running shares found by ranges of values.
    """
    by = by or []
    c = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    c = c if by else c.withColumn("all", F.lit(1))
    keys = by or ["all"]
    c = running(c, keys, value, ["a", "b"])
    gap = F.abs(F.try_divide("sum_a", "all_a") - F.try_divide("sum_b", "all_b"))
    d = c.withColumn("gap", gap).groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.max("gap").alias("d"))
    n = F.sqrt(F.try_divide(F.col("n1") * F.col("n2"), F.col("n1") + F.col("n2")).cast("double"))
    x = n * F.col("d")
    series = reduce(lambda acc, k: acc + 2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x), range(1, 101), F.lit(0.0))
    return d.withColumn("p", F.when(F.col("d").isNull(), None).when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))).drop("all")


def ecdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values with the share of rows up to them."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running(c, by, value, ["n"]).select(*by, value, (F.col("sum_n") / F.col("all_n")).alias("share"))


def histogram(df: DataFrame, value: str, by: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Counts and densities in equal bins, the last one closed; other values are left out."""
    width = (high - low) / bins
    x = df.where(F.col(value).between(low, high)).withColumn("bin", F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)))
    c = x.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return c.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*by)) * width))


def box_numbers(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """What a box plot shows: quartiles, whiskers at most 1.5 ranges away, mean and n."""
    df = materialize(df.select(*by, value), "values")
    q = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    # written, as a table of known size is sent to the rows; unknown, all rows of a group would be sorted in one task
    q = materialize(joined(q, percentiles(df, value, by, {"q1": 0.25, "median": 0.5, "q3": 0.75}), by), "quartiles")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    w = df.join(q, by).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)).groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return q.join(w, by)


def median_spread(df: DataFrame, median: str) -> DataFrame:
    """100 (max - min) / median of medians; NULL for under two or a median near zero."""
    m = df.agg(F.count(median).alias("n"), F.max(median).alias("a"), F.min(median).alias("b"), F.median(median).alias("m"))
    return m.select(F.when((F.col("n") > 1) & (F.abs("m") >= 1e-12), 100 * (F.col("a") - F.col("b")) / F.col("m")).alias("delta_pct"))


def p_text(p: Column) -> Column:
    return F.when(p.isNull(), "n/a").when(p < 0.001, "p<0.001").otherwise(F.format_string("p=%.3f", p))


def p_class(p: Column) -> Column:
    """The class of a probability as comparisons of regions name it."""
    classes = F.when(p < 1e-4, "p<1e-4").when(p < 1e-3, "p<0.001").when(p < 1e-2, "p<0.01").when(p < 0.05, "p<0.05")
    return F.when(p.isNull() | F.isnan(p), "p=NA").otherwise(F.coalesce(classes, F.format_string("ns (p=%.2f)", p)))


def p_stars(p: Column, most: int = 4) -> Column:
    """Four stars at most, and nothing where p is missing; or three, and NA there."""
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    if most == 3:
        return F.when(p.isNull() | F.isnan(p), "NA").otherwise(stars)
    return F.when(p.isNull(), "").when(p < 0.0001, "****").otherwise(stars)
