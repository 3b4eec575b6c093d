"""Connected components of a link table, by stars that shrink towards the smallest node."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.work import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (a, b: orderable ids); root is the smallest node reachable.

    Each round links every neighbour of a node to the smallest of them, larger neighbours first,
    then smaller ones; rounds end when nothing changes, about log(diameter) of them. Minima are
    pre-aggregated, each join has one row for a node on one side, and each round is a written table.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = written(edges, "edges"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now == last or not now.n:
            break
        last = now
        both = _both(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = written(small, "edges")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
