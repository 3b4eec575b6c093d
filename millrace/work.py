"""Tables in the folder that the cluster shares: what ends a lineage must outlive the executors that made it."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``; removed at the end.

    Where that is unset, local runs (tests) use a temporary folder and clusters are refused, as executors would not share it.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
        _roots[app] = f"{base}/millrace-models-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _roots[app])
    return _roots[app]


def remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """The rows of ``df`` from a table in the shared folder, in folders ``by`` a column if given, and its path."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, column: str, n: int, *order: str) -> DataFrame:
    """A table that later groupings by ``column`` read without a shuffle, each file in ``order``."""
    spark, name = df.sparkSession, f"millrace_{uuid.uuid4().hex}"
    out = df.repartition(n, column).write.option("path", f"{root(spark)}/{name}").bucketBy(n, column)
    (out.sortBy(*order) if order else out).saveAsTable(name)
    atexit.register(drop, spark, name)
    return spark.table(name)


def drop(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
