"""Splits into training and validation, and what evaluation needs of them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(stream: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """The last min(n, length - 1) tokens of each user (distinct) for validation, the rest for training."""
    by_user = Window.partitionBy("u")
    ranked = stream.withColumns({"_from_end": F.row_number().over(by_user.orderBy(F.desc("pos"))), "_n": F.count("*").over(by_user)})
    held = F.col("_from_end") <= F.least(F.lit(n), F.col("_n") - 1)
    return ranked.where(~held).select("u", "pos", "i"), ranked.where(held).select("u", "i").distinct()


def sample(matrix: DataFrame, p: float = 0.01, most: int = 500, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """min(int(p * entries), most) entries for validation, the least by an arithmetic hash of (u, i)."""
    n = min(int(matrix.count() * p), most)
    held = matrix.withColumn("_h", pair_hash("u", "i", seed)).orderBy("_h", "u", "i").limit(n).drop("_h")
    return matrix.join(held.select("u", "i"), ["u", "i"], "left_anti"), held


def sample_stream(stream: DataFrame, p: float = 0.01, most: int = 500, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """min(int(p * tokens), most) places of a stream (u, pos, i) for validation, by hash; other places of the same token stay."""
    n = min(int(stream.count() * p), most)
    held = stream.orderBy(pair_hash("u", "pos", seed), "u", "pos").limit(n)  # ``most`` rows at most
    return stream.join(held.select("u", "pos"), ["u", "pos"], "left_anti"), held.select("u", "pos", "i")


def filled(held: DataFrame, value: float | None = None) -> DataFrame:
    """u, i, v of held tokens: how often each is held, or ``value``."""
    return held.groupBy("u", "i").agg((F.count("*").cast("double") if value is None else F.lit(value)).alias("v"))


def evaluated(users: DataFrame, most: int | None = None, seed: int = 0) -> DataFrame:
    """Users that an evaluation looks at: all, or ``most`` of them by hash."""
    users = users.select("u").distinct()
    return users if most is None else users.orderBy(F.xxhash64("u", F.lit(seed)), "u").limit(most)


def pair_hash(u: str, i: str, seed: int = 0):
    return F.pmod(F.col(u).cast("long") * 2654435761 + F.col(i).cast("long") * 1597334677 + seed * 7919, F.lit(2147483647))


def ground_truth(vali: DataFrame) -> DataFrame:
    return vali.groupBy("u").agg(F.sort_array(F.collect_set("i")).alias("items"))


def seen(train: DataFrame, vali: DataFrame) -> DataFrame:
    """Training items of the users that have validation."""
    return train.join(vali.select("u").distinct(), "u", "left_semi").select("u", "i").distinct()
