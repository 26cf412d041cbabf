"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vgraph.llm import mixing, packing, spelling, sql, vbyte, webp
from vgraph.llm.kneser_ney import quality
from vgraph.llm.licenses import scan_licenses
from vgraph.llm.odd_sketch import near_duplicates
from vgraph.llm.periodic_runs import periodic_runs
from vgraph.llm.rp_forest import near_vectors
from vgraph.llm.run_index import remove_repeats
from vgraph.llm.super_kmers import dedup_windows
from vgraph.llm.url_rules import filter_urls
from vgraph.plans.workspace import materialize

#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of documents that are labelled good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of ``embeddings`` within their labels, at a cosine of 0.98."""
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in ``documents``."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with the label of the document that their path's number names: blocked if bad or toxic."""
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", r"://[^/?#]*/[a-z]+/(\d+)", 1).try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return pages.join(labels, "doc_id").select("url", "block")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every URL of ``pages`` by fixed rules and rules mined from the labels."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labelled_urls(spark, sf_dir), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as lossless WebP, read back, and its digests."""
    media = materialize(webp.store(table(spark, sf_dir, "documents")), "media")
    return webp.read(media, pixels=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op6_vbyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all ``documents`` written in the file format and read back."""
    folder = vbyte.write_ids(table(spark, sf_dir, "documents"), vbyte.new_folder(spark))
    return vbyte.read_ids(spark, folder, ids=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` repeated so that all sources have the same share of characters."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("rate")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexities of all ``documents`` and which are kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality(docs, trusted(spark, sf_dir), quantile=0.995).drop("text")


def op9_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate ``documents`` on two-word shingles at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=2, percent=80)


def op10_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each text in ``documents`` a text of a smaller id has in 50 bytes or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, least=50, texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one of ten documents, told by a checksum of doc_id, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    repeated = F.expr("array_join(transform(sequence(0, n - 1), i -> w[cast(if(i < a, i, a + pmod(i - a, p)) as int)]), ' ')")
    d = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"), F.floor(h / 10).alias("g"))
    d = d.withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    return d.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodic words in every text of ``documents``, with planted periods, and the texts' digests without repeats."""
    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * b.length div -b.p")
    return best.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the words of 13-word windows that a text of a smaller id has."""
    out = dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), n=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def planted_typos(found: DataFrame) -> DataFrame:
    """(word): one of 97 words, told by a checksum of doc_id and word, loses a letter."""
    h, word = F.col("h"), F.col("word")
    at = (h % F.length(word)).cast("int")
    hashed = found.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word)))
    return hashed.select(F.when(h % 97 == 0, F.concat(F.left(word, at), F.substring(word, at + 2, F.length(word)))).otherwise(word).alias("word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of ``documents``, with planted slips, and their more frequent forms one edit away."""
    found = planted_typos(spelling.letter_runs(table(spark, sf_dir, "documents")))
    return spelling.variants(spelling.vocabulary(found, letters=5, least=3), ratio=2)


QUERIES = {f.__name__: f for f in (op1_rp_forest, op2_licenses, op3_url_rules, op4_webp, op5_packing, op6_vbyte, op7_mixing, op8_kneser_ney, op9_odd_sketch, op10_run_index, op11_automaton_runs, op12_super_kmers, op13_spelling)}

ORACLES = {"op7_mixing": mixing.ORACLE, "op11_automaton_runs": sql.OP11, "op12_super_kmers": sql.OP12, "op13_spelling": sql.OP13}
