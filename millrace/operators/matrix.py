"""Forms and facts of an interaction matrix (u, i, v)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.work import written


def adjacency(matrix: DataFrame, axis: str = "u") -> DataFrame:
    """One row for each row (axis u) or column (axis i), its entries sorted."""
    other = "i" if axis == "u" else "u"
    return matrix.groupBy(axis).agg(F.sort_array(F.collect_list(F.struct(other, "v"))).alias("entries"))


def indptr(matrix: DataFrame, axis: str = "u") -> DataFrame:
    """Inclusive running count of entries. Counts are one row for each key; their running sum has two levels."""
    return running(matrix.groupBy(axis).agg(F.count("*").alias("n")), axis, "n", "indptr")


def running(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Inclusive prefix sum in order of ``key`` (distinct, of any type that has an order), without one window over all rows.

    Rows are sorted into ranges, which Spark cuts evenly; the sums of ranges are as few as shuffle partitions.
    """
    rows = written(rows.orderBy(key).withColumn("_range", F.spark_partition_id()), "ranges")[0]
    ranges = rows.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = ranges.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + within).drop("_range", "_before")  # a row for each range


def header(matrix: DataFrame) -> DataFrame:
    return matrix.agg(F.count("*").alias("num_nnz"), F.countDistinct("u").alias("num_users"), F.countDistinct("i").alias("num_items"), F.sum("v").alias("sum_v"), F.max("v").alias("max_v"))


def row(matrix: DataFrame, index: int, axis: str = "u") -> DataFrame:
    return matrix.where(F.col(axis) == index)


def encode(rows: DataFrame, dictionary: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with idx of their key; inner drops unknown keys, left keeps them with null."""
    return rows.join(dictionary.select("idx", F.col("key").alias(key)), key, how)


def decode(rows: DataFrame, dictionary: DataFrame, index: str, name: str) -> DataFrame:
    return rows.join(dictionary.select(F.col("idx").alias(index), F.col("key").alias(name)), index)


def popularity(matrix: DataFrame, items: DataFrame, power: float = 1.0) -> DataFrame:
    """i, n, weight n ** power of every item (idx), with running sums ``cum``."""
    n = matrix.groupBy("i").agg(F.count("*").alias("n"))
    full = items.select(F.col("idx").alias("i")).join(n, "i", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return running(full.withColumn("weight", F.when(F.col("n") > 0, F.pow("n", F.lit(power))).otherwise(0.0)), "i", "weight", "cum")


def negative_weights(matrix: DataFrame, c0: float = 512.0, exponent: float = 0.5) -> DataFrame:
    """c_i = c0 * (n / max n) ** exponent / their sum."""
    n = matrix.groupBy("i").agg(F.count("*").alias("n"))
    f = n.crossJoin(F.broadcast(n.agg(F.max("n").alias("m")))).select("i", F.pow(F.col("n") / F.col("m"), F.lit(exponent)).alias("f"))
    return f.crossJoin(F.broadcast(f.agg(F.sum("f").alias("s")))).select("i", (c0 * F.col("f") / F.col("s")).alias("c"))  # one row on the right
