"""Sources of interaction matrices and id lists, and the stored form of a matrix."""

import atexit
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.work import drop, written


def load(spark: SparkSession, options: dict):
    """A source by ``type``: matrix_market or stream."""
    from millrace.sources import streams

    kind = options.get("type")
    if kind == "matrix_market":
        return matrix_market(spark, options["input"]["main"])
    if kind == "stream":
        return streams.stream(spark, options["input"]["main"])
    raise RuntimeError(f"unknown data type {kind!r}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value of a text: numbers within a task, and what the tasks before hold."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
    rows = written(rows, "lines")[0].withColumn("task", F.shiftright("at", 33))
    tasks = rows.groupBy("task").agg(F.count("*").alias("n"))
    before = tasks.select("task", F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each task
    line = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), "task").select(line.alias("line"), "value")


def _body(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '%')")


def header(spark: SparkSession, path: str) -> dict:
    """Rows, columns and entries that the first line after the comments states."""
    return dict(zip(("num_users", "num_items", "num_nnz"), map(int, _body(spark, path).first().line.split()), strict=True))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate text: u, i (from 0) and v. The header is the first data line of the file.

    Entries keep no order; the header line is found by its place in the file, not by its values.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where("line <> '' AND NOT startswith(line, '%')")
    first = lines.agg(F.min("at").alias("first"))
    parts = F.split("line", r"\s+")
    cols = [(parts[0].cast("int") - 1).alias("u"), (parts[1].cast("int") - 1).alias("i"), parts[2].cast("float").alias("v")]
    return lines.crossJoin(F.broadcast(first)).where("at > first").select(*cols)  # one row on the right


def from_arrays(spark: SparkSession, main) -> DataFrame:
    """A dense two-dimensional array, or a sparse one with row, col and data, without its zeros."""
    import numpy as np
    import pandas as pd

    if hasattr(main, "tocoo"):
        main = main.tocoo()
        u, i, v = main.row, main.col, main.data
    elif isinstance(main, np.ndarray) and main.ndim == 2:
        u, i = main.nonzero()
        v = main[u, i]
    else:
        raise TypeError("a two-dimensional array or a sparse matrix is needed")
    rows = pd.DataFrame({"u": np.asarray(u, "int32"), "i": np.asarray(i, "int32"), "v": np.asarray(v, "float32")})
    return spark.createDataFrame(rows, "u int, i int, v float")


def ids(spark: SparkSession, source, n: int | None = None) -> DataFrame:
    """Dictionary idx, key: a path (a line each), a list, or None for "1" to str(n)."""
    if source is None:
        return spark.range(n).select(F.col("id").cast("int").alias("idx"), (F.col("id") + 1).cast("string").alias("key"))
    if isinstance(source, str):
        return numbered_lines(spark, source).select(F.col("line").cast("int").alias("idx"), F.trim("value").alias("key"))
    keys = [str(x) for x in source]
    if n is not None and len(keys) != n:
        raise TypeError(f"{len(keys)} ids for {n} rows")
    return spark.createDataFrame(list(enumerate(keys)), "idx int, key string")


def _listed(matrix: DataFrame, path: str, key: str, other: str, buckets: int) -> None:
    """Files of one orientation: a bucket of rows in each, in order of rows."""
    name = f"millrace_{uuid.uuid4().hex}"
    matrix.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key, other).saveAsTable(name)
    drop(matrix.sparkSession, name)  # the files stay


def store(matrix: DataFrame, path: str, users: DataFrame | None = None, items: DataFrame | None = None, buckets: int | None = None, made_of=None) -> None:
    """Writes both orientations, each in buckets of its rows and sorted, with the dictionaries, and a header last.

    ``buckets``: as many as shuffle partitions by default; ``made_of``: what the matrix was built from, for ``cached``.
    """
    buckets = buckets or int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for axis, key, other in (("rowwise", "u", "i"), ("colwise", "i", "u")):
        _listed(matrix, f"{path}/{axis}", key, other, buckets)
    for name, table in (("users", users), ("items", items)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    facts = matrix.agg(F.count("*").alias("num_nnz"), (F.max("u") + 1).alias("num_users"), (F.max("i") + 1).alias("num_items")).first().asDict()
    value = json.dumps({"facts": facts, "buckets": buckets, "schema": matrix._jdf.schema().toDDL(), "made_of": made_of})
    matrix.sparkSession.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def _header(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/header").first().value)


def opened(spark: SparkSession, path: str, axis: str = "rowwise") -> tuple[DataFrame, dict]:
    """A stored matrix and its facts; the header is written last, so without one the store is not complete.

    The files are opened as a bucketed table: a filter on one row reads its bucket only, and in that the row groups that can have it.
    """
    head, name = _header(spark, path), f"millrace_{uuid.uuid4().hex}"
    key, other = ("u", "i") if axis == "rowwise" else ("i", "u")
    place = f"{path}/{axis}".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({head['schema']}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}, {other}) INTO {head['buckets']} BUCKETS LOCATION '{place}'")
    atexit.register(drop, spark, name)
    return spark.table(name), head["facts"]


def fingerprint(spark: SparkSession, *paths: str) -> list[list]:
    """Path, bytes and time of change of the files that a source reads."""
    out = []
    for given in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(given)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for found in fs.globStatus(path) or []:
            files = fs.listFiles(found.getPath(), True)
            while files.hasNext():
                f = files.next()
                out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def cached(spark: SparkSession, path: str, build, made_of=None) -> DataFrame:
    """The stored matrix if it is complete and of the same ``made_of`` (options, fingerprints: what JSON holds), else what ``build()`` gives, stored."""
    from pyspark.errors import AnalysisException

    try:
        if _header(spark, path)["made_of"] == json.loads(json.dumps(made_of)):
            return opened(spark, path)[0]
    except AnalysisException:
        pass
    store(build(), path, made_of=made_of)
    return opened(spark, path)[0]


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").csv(path)
