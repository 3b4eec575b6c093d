from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import pytest
from oracle import SF
from pyspark.sql import functions as F

from millrace.llm import sharding
from millrace.llm.queries import op12_sharding


def key(r):
    return tuple((x is not None, x) for x in (r.doc_id, r.source, r.size, r.text_crc32))


def brute(units, shards, law):
    """Rows by fraction of their rank in the seeded order of their source, cut."""
    rows = [(r.h, key(r), r) for r in units.withColumn("h", F.xxhash64(F.lit(42), *sharding.UNITS)).collect()]
    by_source = defaultdict(list)
    for h, k, r in rows:
        by_source[r.source].append(((h % 2**64) >> 1, k, r))
    placed = []
    for source, found in by_source.items():
        found.sort(key=lambda x: x[:2])
        placed += [(Fraction(2 * rank + 1, 2 * len(found)), (source is not None, source), rank, x[2]) for rank, x in enumerate(found)]
    placed.sort(key=lambda x: x[:3])
    total, at, out, slots = sum(x[3].size for x in placed), 0, Counter(), Counter()
    for k, (*_, r) in enumerate(placed):
        shard = max(s for s in range(shards) if s * len(placed) // shards <= k) if law == "rows" else min(shards - 1, shards * (2 * at + r.size) // (2 * total))
        out[r.doc_id, r.source, r.size, r.text_crc32, shard, slots[shard]] += 1
        slots[shard] += 1
        at += r.size
    return out


@pytest.mark.parametrize("law", ["rows", "bytes"])
@pytest.mark.parametrize("shards, least", [(7, 1), (40, 16)])
def test_against_brute_force(spark, docs, texts, monkeypatch, law, shards, least):
    monkeypatch.setattr(sharding, "LEAST_RANGES", least)
    monkeypatch.setattr(sharding, "PIECE", 3)
    units = sharding.described(docs.unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.explode(F.array_repeat(F.lit(None).cast("long"), 20)))))
    rows = sharding.interleave(units, shards, law).collect()
    assert Counter((r.doc_id, r.source, r.size, r.text_crc32, r.shard, r.slot) for r in rows) == brute(units, shards, law)
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) + 40
    if law == "rows":
        assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == shards


def test_every_shard_matches_the_mixture(spark):
    n = {"a": 3000, "b": 600, "c": 40, None: 360}
    units = spark.createDataFrame([(k, s, 16, 0) for s, m in n.items() for k in range(m)], ", ".join(f"{c} {t}" for c, t in zip(sharding.UNITS, ("long", "string", "long", "long"), strict=True)))
    held = Counter((r.shard, r.source) for r in sharding.interleave(units, 40).collect())
    for (shard, source), k in held.items():
        assert abs(k - n[source] / 40) <= 2, (shard, source)


def test_described_and_empty(spark, docs, texts, empty):
    got = Counter((r.doc_id, r["size"], r.text_crc32) for r in sharding.described(docs).collect())
    assert got == Counter((i, len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t in texts)
    assert sharding.interleave(sharding.described(empty)).count() == 0
    with pytest.raises(ValueError):
        sharding.interleave(sharding.described(empty), law="key")


def test_query_and_files(spark, tmp_path):
    rows = op12_sharding(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == docs.count() and rows.select("shard", "slot").distinct().count() == docs.count()
    assert rows.groupBy("shard").agg(F.max("slot").alias("m"), F.count("*").alias("n")).where("m + 1 <> n").count() == 0
    sharding.write(docs.drop("source").withColumn("source", F.lit("s")), rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.groupBy("shard").count().count() == 40 and back.select(*docs.columns).exceptAll(docs.withColumn("source", F.lit("s"))).count() == 0
