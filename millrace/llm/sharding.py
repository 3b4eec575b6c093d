"""Shards that mirror the mixture of sources: proportional stratified interleaving (operator 12).

Rows are shuffled by a seed within their source and ranked; row r of n has the fraction (2r + 1) / 2n. In order of fractions the
sources stand as evenly mixed as their sizes allow, so any cut of that order holds each source in its share. ``interleave``
cuts it by counts (law ``rows``: at most one row apart) or by sizes (law ``bytes``: at most one row's size from even).

Nothing is sorted as a whole: ranks come from counts by (source, range of hashes), places from counts by range of fractions,
and rows meet only within such a range of about ``per_range`` rows. A source with most rows has as many more ranges. Rows equal
in all that is looked at are interchangeable: they are counted first and told apart by ranks only.

Null sources are a source; null texts have no bytes; null ids are shuffled like others by what else the row has. Equal texts of
different ids are rows of their own and spread over shards, as no cut at equal counts could hold a large group of them. Rows of
equal fraction are ordered by source. Empty tables give no rows. Further columns are left out; texts are joined on by ``write``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.work import written

PER_RANGE, LEAST_RANGES, PIECE = 200_000, 64, 4096
UNITS = ["doc_id", "source", "size", "text_crc32"]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes and 16), text_crc32 of each row."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))


def _before(df: DataFrame, of: list[str], by: str, *sums: str) -> DataFrame:
    """Sums of earlier ranges ``by`` of the same ``of``; a row for each range, so windows hold as many rows as ranges."""
    w = Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"{x}_before": F.coalesce(F.sum(x).over(w), F.lit(0)) for x in sums})


def ranked(units: DataFrame, ranges: int, seed: int) -> DataFrame:
    """UNITS with rank and n: each row's place among the n rows of its source after a shuffle by ``seed``."""
    # equal rows are one with a count; a hash that equal hashes don't order apart is followed by the row itself
    once = units.groupBy(*UNITS).agg(F.count("*").alias("copies")).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *UNITS), 1))
    once = once.withColumn("range", F.expr(f"(shiftright(h, 32) * {ranges}) div {1 << 31}"))
    counts = once.groupBy("source", "range").agg(F.sum("copies").alias("k"))
    counts = _before(counts, ["source"], "range", "k").withColumn("n", F.sum("k").over(Window.partitionBy("source")))
    facts = counts.select(F.col("source").alias("_source"), F.col("range").alias("_range"), "k_before", "n")
    within = Window.partitionBy("source", "range").orderBy("h", *UNITS).rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn("first", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    placed = placed.join(facts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
    first = F.col("k_before") + F.col("first")
    # copies come out in pieces, so that no array grows with their number
    pieces = placed.select(*UNITS, "n", first.alias("first"), "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {PIECE}"))).alias("piece"))
    each = F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("piece") * PIECE + PIECE, F.col("copies")) - 1))
    return pieces.select(*UNITS, "n", "first", each.alias("copy")).select(*UNITS, "n", (F.col("first") + F.col("copy")).alias("rank"))


def _shard(law: str, shards: int, rows: Column, size: Column) -> Column:
    """The last shard that starts at or before the row's place, of starts floor(k * total / shards)."""
    if law == "rows":
        return F.expr(f"(({shards} * (place + 1) - 1) div rows)")
    return F.least(F.lit(shards - 1), F.expr(f"(({shards} * (2 * bytes_at + size)) div (2 * bytes))"))


def interleave(units: DataFrame, shards: int = 40, law: str = "rows", seed: int = 42, per_range: int = PER_RANGE) -> DataFrame:
    """UNITS with law, shard (int) and slot (long, gapless from 0 in each shard), in order of fractions within shards."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"law {law!r} is not rows or bytes")
    units = written(units.select(*UNITS), "units")
    total = units.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranges = max(LEAST_RANGES, total["rows"] // per_range)
    rows = ranked(units, ranges, seed).withColumn("range", F.expr(f"((2 * rank + 1) * {ranges}) div (2 * n)"))
    rows = written(rows, "ranked")  # counted, then placed
    counts = _before(rows.groupBy("range").agg(F.count("*").alias("k"), F.sum("size").alias("b")), [], "range", "k", "b")
    order = Window.partitionBy("range").orderBy((2 * F.col("rank") + 1) / (2 * F.col("n")), "source", "rank")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"at": F.row_number().over(order) - 1, "sizes": F.coalesce(F.sum("size").over(earlier), F.lit(0))})
    placed = placed.join(counts.select("range", "k_before", "b_before"), "range").withColumns({
        "place": F.col("k_before") + F.col("at"), "bytes_at": F.col("b_before") + F.col("sizes"), "rows": F.lit(total["rows"]), "bytes": F.lit(total["bytes"]),
    })
    placed = placed.withColumn("shard", _shard(law, shards, F.col("rows"), F.col("size")).cast("int"))
    if law == "rows":
        start = F.expr(f"(shard * rows) div {shards}")
        return placed.select(*UNITS, F.lit(law).alias("law"), "shard", (F.col("place") - start).alias("slot"))
    placed = written(placed.select(*UNITS, "shard", "place"), "placed")
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").select(*UNITS, F.lit(law).alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"))


def write(docs: DataFrame, placed: DataFrame, path: str, files: int = 1) -> None:
    """``docs`` as Parquet folders ``shard=k``, each of ``files`` files in order of slots, so that no task needs a whole shard.

    Ids must be without repeats and nulls.
    """
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartitionByRange(max(int(n), int(files)), "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
