"""Shared folders, written stages and small helpers of the training-data operators."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.work import root as work_root

#: What separates words: space and the code points 9 to 13.
SPACES = " \t\n\x0b\f\r"
SPACES_RE = "[\\x20\\x09-\\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder: later reads need no executor that wrote it."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def words(text):
    """Words of a text column: runs of other than SPACES; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES_RE))


def checkpoints(spark: SparkSession) -> None:
    """Lets ``RDD.checkpoint`` write below ``work_root`` where the session has no folder of its own."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{work_root(spark)}/rdds")
