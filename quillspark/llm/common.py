"""Helpers that the training-text operators share: tables, the shared folder, lambda bindings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Written:
    """A table written to the shared folder: cuts lineage, survives lost executors, can be dropped early."""

    def __init__(self, df: DataFrame, name: str, compression: str = "snappy"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        # once the table is there, the shuffle files behind it are of no use
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(clean, "false")
        self.spark.conf.set(clean, "true")
        try:
            df.write.option("compression", compression).parquet(self.path)
        finally:
            self.spark.conf.set(clean, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


def let(value: Column, body) -> Column:
    """Evaluate value once and use it many times in body; plain column references inside lambdas would be evaluated anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def parts_of(text: Column, gaps: str) -> Column:
    """The non-empty parts between gaps: what regexp_extract_all finds for the opposite class, at an eighth of its time."""
    return F.array_remove(F.split(text, gaps, -1), "")


def words_of(text: Column) -> Column:
    return parts_of(text, SPACES)


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def positions(n: Column) -> Column:
    """0 .. n-1; empty where n < 1 (sequence alone would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
