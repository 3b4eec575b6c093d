"""Buckets of texts that exchange keys with shards: which keys do several documents have?

Texts are dealt to buckets once, in a bucketed table of the shared folder that later stages read
without a shuffle. Buckets send their distinct keys (40 bits, in order) to shards, which are
ranges of keys; a shard answers with a bit for each key. Repeats are joined before they are sent.
"""

import atexit
import uuid
from collections.abc import Callable
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.work import work_root, written

KEY_BITS = 40
SIDE = "bucket int, shard int"


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys, so that keys in order are in order of shards."""
    return (key >> 8) * shards >> (KEY_BITS - 8)


def bucket_of(ident, n: int):
    return F.pmod(F.xxhash64(ident), F.lit(n)).cast("int")


def n_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n


def bucketed(docs: DataFrame, ident: str, text: str, more: list[str] = (), size: int | None = None) -> tuple[DataFrame, int]:
    """bucket, doc_id, t (bytes) and more columns as x0, x1, ...; and the number of buckets for ``size`` bytes."""
    spark = docs.sparkSession
    size = n_bytes(docs, text) if size is None else size
    # buckets grow with the root of the input, as each sends to each shard, up to 64 MB
    n = max(1, ceil(max(sqrt(size / 8e3), size / 64e6)))
    rest = [F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(more)]
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("t"), *rest)
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), n))
    name = f"texts_{uuid.uuid4().hex}"
    rows.repartition(n, "bucket").write.option("compression", "zstd").option("path", f"{work_root(spark)}/{name}").bucketBy(n, "bucket").saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name), n


def _drop(spark, name: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def cut_by_shard(key: np.ndarray, n: int) -> tuple[np.ndarray, Callable]:
    """The shards of keys in order, and a function that cuts arrays beside them."""
    shard, first = np.unique(shard_of(key, n), return_index=True)
    return shard, lambda x: np.split(x, first[1:]) if len(first) else []


def shared(texts: DataFrame, make: Callable, n: int, hot: int | None = None) -> DataFrame:
    """bucket, shard, shared (bits), n, hot (places): for each bucket's distinct keys if several documents have them, and which occur over ``hot`` times.

    ``make`` builds from a bucket's rows an object with ``keys()``: distinct keys in order, which of them several of its
    documents have, and how often each occurs.
    """

    def send(table: pa.Table) -> pa.Table:
        key, several, count = make(table).keys()
        shard, cut = cut_by_shard(key, n)
        often = [np.flatnonzero(x > 1) for x in cut(count)]  # the others once
        return pa.table({
            "bucket": pa.array([table["bucket"][0].as_py()] * len(shard), pa.int32()), "shard": pa.array(shard, pa.int32()),
            "keys": pa.array([x.astype("<u4").tobytes() for x in cut(key & 0xFFFFFFFF)], pa.binary()), "several": pa.array([np.packbits(x).tobytes() for x in cut(several)], pa.binary()),
            "often": pa.array([np.concatenate((at, x[at])).astype("<u4").tobytes() if hot else b"" for at, x in zip(often, cut(count), strict=True)], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, "<u4") for x in table["keys"].to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[: len(k)] for x, k in zip(table["several"].to_pylist(), keys, strict=True)])
        key = np.concatenate(keys)
        order = np.argsort(key)
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        found = several.astype(bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        ends = np.cumsum([len(k) for k in keys])
        out = np.split(found, ends[:-1])
        many = [np.zeros(0, np.int64)] * len(keys)
        if hot:
            count = np.ones(len(key), np.int64)
            for end, k, x in zip(ends.tolist(), keys, table["often"].to_pylist(), strict=True):
                at, times = np.frombuffer(x, "<u4").reshape(2, -1)
                count[end - len(k) + at.astype(np.int64)] = times
            heads = np.flatnonzero(np.concatenate(([True], ~same))) if len(key) else np.zeros(0, np.int64)
            total = np.zeros(len(key), bool)
            if len(key):
                total[order] = np.repeat(np.add.reduceat(count[order], heads) > hot, np.diff(np.append(heads, len(key))))
            many = [np.flatnonzero(x) for x in np.split(total, ends[:-1])]
        return pa.table({
            "bucket": table["bucket"], "shard": table["shard"], "shared": pa.array([np.packbits(x).tobytes() for x in out], pa.binary()), "n": pa.array([len(x) for x in out], pa.int32()),
            "hot": pa.array([x.astype("<u4").tobytes() for x in many], pa.binary()),
        })

    sent = texts.groupBy("bucket").applyInArrow(send, f"{SIDE}, keys binary, several binary, often binary")
    return written(sent.groupBy("shard").applyInArrow(answer, f"{SIDE}, shared binary, n int, hot binary"), "answers")


def shared_keys(bucket, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a bucket's keys, in order: those that ``answers`` say several documents have, and which of these are hot."""
    answers = answers.sort_by("shard")
    bits = [np.unpackbits(np.frombuffer(x, np.uint8))[:k] for x, k in zip(answers["shared"].to_pylist(), answers["n"].to_pylist(), strict=True)]
    key = bucket.keys()[0]
    if not bits:
        return key[:0], np.zeros(0, bool)
    several, hot = np.concatenate(bits).astype(bool), np.zeros(len(key), bool)
    for start, x in zip(np.cumsum([0, *map(len, bits)]).tolist(), answers["hot"].to_pylist(), strict=False):
        hot[start + np.frombuffer(x, "<u4").astype(np.int64)] = True
    return key[several], hot[several]


def gathered(table: pa.Table, column: str, dtype) -> np.ndarray:
    """A bucket's blobs from all shards, in order of shards."""
    blobs = table.sort_by("shard")[column].to_pylist()
    return np.concatenate([np.frombuffer(x, dtype) for x in blobs]) if blobs else np.zeros(0, dtype)
