"""Where intermediate tables live.

Lineage is cut by writing a table into the folder that all machines share
(``spark.checkpoint.dir``), so a lost executor costs a re-read, not a re-run.
Such tables are well compressed: rows take many times the bytes of their files, and a plan that went by
these would send large tables through the driver. So their size is reckoned as ``GROWN`` times the files'.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows for a byte of a compressed file, for plans; a session that sets the figure keeps its own.
GROWN = 16
_FACTOR = "spark.sql.sources.fileCompressionFactor"
_OWN: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only on a single machine where none is set."""
    if float(spark.conf.get(_FACTOR)) == 1.0:
        spark.conf.set(_FACTOR, str(float(GROWN)))
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="spark-work-")
    return _OWN[key]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that grows by the rows of one round at a time, each written once."""

    def __init__(self, spark: SparkSession, tag: str, columns: str):
        self.spark, self.columns, self.folder, self.level = spark, columns, f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}", -1

    def add(self, rows: DataFrame) -> DataFrame:
        self.level += 1
        place = f"{self.folder}/level={self.level}"
        rows.write.parquet(place)
        return self.spark.read.schema(self.columns).parquet(place)

    def all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, level int").parquet(self.folder)
