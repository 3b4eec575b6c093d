"""Value pre-processing of interactions, by name."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identity(df: DataFrame, value: str = "v") -> DataFrame:
    return df


def one_based(df: DataFrame, value: str = "v") -> DataFrame:
    return df.withColumn(value, F.lit(1.0))


def min_max(df: DataFrame, value: str = "v", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Scaled to low..high by the true minimum and maximum; all ``high`` where these are equal."""
    ends = df.agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    scaled = (F.col(value) - F.col("_min")) / (F.col("_max") - F.col("_min")) * (high - low) + low
    out = df.crossJoin(F.broadcast(ends))  # one row on the right
    return out.withColumn(value, F.when(F.col("_max") - F.col("_min") < 1e-8, F.lit(float(high))).otherwise(scaled)).drop("_min", "_max")


def implicit_log(df: DataFrame, value: str = "v", epsilon: float = 1.0) -> DataFrame:
    return df.withColumn(value, F.log(1 + F.col(value) / epsilon))


def sppmi(df: DataFrame, value: str = "v") -> DataFrame:
    raise RuntimeError("a matrix has no order; SPPMI is built from streams")


PREPRO = {"PreProcess": identity, "OneBased": one_based, "MinMaxScalar": min_max, "ImplicitALS": implicit_log, "SPPMI": sppmi}


def apply(df: DataFrame, name, **options) -> DataFrame:
    """By name, or by a function of a table and options."""
    if callable(name):
        return name(df, **options)
    if name not in PREPRO:
        raise ValueError(f"unknown pre-processing {name!r}")
    return PREPRO[name](df, **options)
