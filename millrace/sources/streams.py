"""Ordered token streams: one line for each user."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tokens(lines: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0) and token of white-space separated text."""
    parts = F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r")), r"\s+")
    return lines.select(F.col(key), F.posexplode(parts).alias("pos", "token")).where("token <> ''")


def stream(spark: SparkSession, path: str, users: DataFrame | None = None) -> DataFrame:
    """user, pos, token of a text file; the user is the line's number or its key in ``users`` (idx, key)."""
    from millrace.sources.matrix import numbered_lines

    out = tokens(numbered_lines(spark, path).withColumnRenamed("line", "user"), "user", "value")
    if users is not None:
        out = out.join(users, F.col("user") == F.col("idx")).select(F.col("key").alias("user"), "pos", "token")
    return out


def ordered(rows: DataFrame, user: str, token: str, *order: str) -> DataFrame:
    """u, pos, i: positions within each user by ``order``, which must be total."""
    at = F.row_number().over(Window.partitionBy(user).orderBy(*order)) - 1
    return rows.select(F.col(user).alias("u"), at.alias("pos"), F.col(token).alias("i"))


def to_matrix(stream: DataFrame) -> DataFrame:
    """u, i and how often i occurs."""
    return stream.groupBy("u", "i").agg(F.count("*").alias("v"))


def lines(stream: DataFrame) -> DataFrame:
    """u and value: the tokens (u, pos, i) of each user in a line."""
    held = F.array_sort(F.collect_list(F.struct("pos", "i")))
    return stream.groupBy("u").agg(F.array_join(F.transform(held, lambda x: x["i"].cast("string")), " ").alias("value"))


def ratings(table: DataFrame, user: str, item: str, value: str, time: str, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A data set of ratings as matrix (u, i, v), stream (u, pos, i), users and items (idx, key).

    Users and items are numbered from 0 in order of their keys; ``names`` (key, name) gives items other names in the stream and
    the dictionary. Streams are in order of time, equal times in order of items.
    """
    from millrace.operators.matrix import running

    def numbered(rows: DataFrame) -> DataFrame:
        return running(rows.withColumn("_one", F.lit(1).cast("long")), "key", "_one", "_n").select((F.col("_n") - 1).cast("int").alias("idx"), *[c for c in rows.columns])

    users = numbered(table.select(F.col(user).alias("key")).distinct())
    items = table.select(F.col(item).alias("key")).distinct() if names is None else names.select("key", "name")
    items = numbered(items)
    shown = F.col("name") if names is not None else F.col("key")
    at = table.select(F.col(user).alias("_u"), F.col(item).alias("_i"), F.col(value).cast("float").alias("v"), F.col(time).alias("_t"))
    at = at.join(users.select(F.col("key").alias("_u"), F.col("idx").alias("u")), "_u").join(items.select(F.col("key").alias("_i"), F.col("idx").alias("i"), shown.alias("_name")), "_i")
    held = ordered(at, "u", "_name", "_t", "i")
    return at.select("u", "i", "v"), held, users.select("idx", "key"), items.select("idx", shown.alias("key"))


def rating_file(spark: SparkSession, path: str, sep: str = "\t", header: bool = False) -> DataFrame:
    """user, item, value, time: the first four columns of a text file, as MovieLens has them (tabs without header, or commas with one)."""
    rows = spark.read.option("sep", sep).option("header", header).csv(path)
    return rows.select(*[F.col(f"`{c}`").alias(name) for c, name in zip(rows.columns, ("user", "item", "value", "time"), strict=False)]).withColumns({"value": F.col("value").cast("float"), "time": F.col("time").cast("long")})


def lines_of(text: DataFrame, column: str, per_line: int = 1000) -> DataFrame:
    """Words of each row in lines of ``per_line``, cut within the row."""
    trimmed = F.btrim(F.col(column), F.lit(" \t\n\x0b\f\r"))
    at = lambda w: F.sequence(F.lit(0), F.floor((F.size(w) - 1) / per_line).cast("int"))
    cut = lambda w: F.transform(at(w), lambda k: F.array_join(F.slice(w, k * per_line + 1, per_line), " "))
    # in an array of its own, so that a row is split once and not for each line
    return text.where(trimmed != "").select(F.explode(F.flatten(F.transform(F.array(F.split(trimmed, r"\s+")), cut))).alias("value"))
