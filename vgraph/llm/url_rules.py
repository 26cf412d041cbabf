"""URL filtering by association rules, with host and path rules that come first.

Spark's FP-growth mines combinations of URL tokens that go with the label block;
rules with few blocked URLs, a low confidence or one that chance explains are pruned. A rule is filed under its rarest
token; URLs meet it by a join on that token and must hold its other tokens too.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vgraph.plans.workspace import materialize

BLOCK = "=block"
#: Blocked URLs that a rule needs, at any size of the table.
LEAST = 30
#: Deviations by which a rule's blocked share must be above that of all labelled URLs.
DEVIATIONS = 3.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: After the first ://, the host, the path, and what follows.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels from the right with their place, path words, and names of query fields.

    Runs of digits are written 0, so that numbered pages share their tokens. A null URL or one without :// has none.
    """
    labels = F.transform(F.reverse(F.split(host(url), r"\.")), lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.split(F.regexp_replace(path(url), r"\d+", "0"), r"[/._-]+"), lambda x: F.concat(F.lit("path:"), x))
    rest = F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))
    fields = F.transform(F.regexp_extract_all(rest, F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("field:"), x))
    found = F.array_distinct(F.filter(F.concat(labels, words, fields), lambda x: ~F.endswith(x, F.lit(":"))))
    return F.when(F.contains(url, F.lit("://")), found).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float | None = None, confidence: float = 0.6) -> DataFrame:
    """(items, key, confidence, support) of the rules from tokens to the label block.

    ``labelled`` has (url, block boolean); rows with a null in either are left out. ``support`` is the share of all labelled URLs that
    hold the tokens and are blocked, by default that of ``LEAST`` URLs; ``confidence`` the blocked share of those that hold them, whose
    lower bound (Wilson's, ``DEVIATIONS`` below) must be above the share of all. ``key`` is the rarest token.
    A rule that holds another's tokens at no higher confidence is dropped.
    """
    rows = labelled.where("url is not null and block is not null").select(tokens(F.col("url")).alias("items"), "block").where(F.size("items") > 0)
    rows = materialize(rows.select(F.when(F.col("block"), F.array_append("items", BLOCK)).otherwise(F.col("items")).alias("items")), "items")
    empty = rows.sparkSession.createDataFrame([], "items array<string>, key string, confidence double, support double")
    total, blocked = rows.agg(F.count("*"), F.count_if(F.array_contains("items", BLOCK))).first()
    if support is None:
        support = (LEAST - 0.5) / max(total, 1)
    if not blocked or blocked < support * total:
        return empty
    fitted = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    rules = fitted.associationRules.where(F.element_at("consequent", 1) == BLOCK).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    # how many hold a rule's tokens
    n, z = F.col("support") * total / F.col("confidence"), DEVIATIONS
    lower = (F.col("confidence") + z * z / (2 * n) - z * F.sqrt(F.col("confidence") * (1 - F.col("confidence")) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    rules = rules.where(lower > blocked / total)
    single = fitted.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("item"), "freq")
    spread = rules.select("items", "confidence", "support", F.explode("items").alias("item")).join(single, "item")
    keyed = spread.groupBy("items").agg(F.min_by("item", F.struct("freq", "item")).alias("key"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    keyed = materialize(keyed, "rules")
    # a more general rule is filed under one of the tokens of the special one
    general = keyed.select(F.col("items").alias("few"), "key", F.col("confidence").alias("at_least"))
    special = keyed.select("items", "confidence", F.explode("items").alias("key")).join(general, "key")
    covered = special.where((F.size("few") < F.size("items")) & (F.size(F.array_except("few", "items")) == 0) & (F.col("at_least") >= F.col("confidence"))).select("items").distinct()
    return materialize(keyed.join(covered, "items", "left_anti").select("items", "key", "confidence", "support"), "rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the distinct URLs that a rule fits, with the highest confidence of those."""
    held = urls.select("url").where("url is not null").distinct().select("url", tokens(F.col("url")).alias("tokens"))
    spread = held.select("url", "tokens", F.explode("tokens").alias("key"))
    hits = spread.join(rules, "key").where(F.size(F.array_except("items", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def fixed_rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, host, path) rules that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], support: float | None = None, confidence: float = 0.6) -> DataFrame:
    """The rows of ``pages`` (page_id, url, more) with host, path, rule, verdict and confidence added.

    The longest fitting host and path rule decides, or else whether a mined rule fits: block or allow. A null URL or one
    without :// has an empty host and path and, like one that no rule fits, is allowed. Rows with equal URLs are judged alike.
    Columns of ``pages`` with the added names are replaced.
    """
    added = ("host", "path", "rule", "verdict", "confidence")
    pages = pages.select([pages[c] for c in pages.columns if c not in added])
    found = matched(pages, mine(labelled, support, confidence))
    names = pages.columns
    out = pages.join(found, "url", "left").select(*names, "confidence")
    out = out.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select(*names, "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "confidence")
