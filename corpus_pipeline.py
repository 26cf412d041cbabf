"""The corpus pipeline: quality filter, near-dedup, repeat removal, mixing and packing of the table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vgraph.llm.kneser_ney import quality
from vgraph.llm.mixing import mix_sources
from vgraph.llm.odd_sketch import near_duplicates
from vgraph.llm.packing import pack
from vgraph.llm.queries import trusted
from vgraph.llm.run_index import remove_repeats
from vgraph.plans.workspace import materialize

#: Bytes of a passage that must not repeat; passages of over 50 words are longer.
PASSAGE = 100


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text of their language."""
    return quality(docs, trusted(spark, sf_dir), quantile=0.995).where("kept").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, similarity 0.8)."""
    gone = near_duplicates(docs, n=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; n_chars follows."""
    cut = remove_repeats(docs, least=PASSAGE)
    return cut.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text"))).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have the same share of characters."""
    return mix_sources(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 ids."""
    return pack(docs, with_ids=False)


STAGES = [("quality classifier", good_text), ("MinHash near-dedup", one_of_each), ("suffix-array dedup", no_repeats), ("mixing sources to target weights", mixed), ("packing", packed)]

#: SQL cannot express the model, the index or the plan; a test holds the whole run against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
