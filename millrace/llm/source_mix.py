"""Mixing overlapping sources to target weights by min-cost flow (operator 1).

Documents are summed by membership pattern (the set of sources that hold them). A flow
network leads from each pattern to its sources: a pattern gives its words once at no cost,
a second time at cost 1, a third time at cost 2 and so on (convex), up to ``repeats`` times;
each source takes its quota. Successive cheapest paths fill the quotas with least repetition.
Within a pattern, documents are laid out in seeded order, and each source takes an interval
of that line; a document's words in the intervals are what the mix takes.

The network has one node for each pattern and source; it is solved on the driver and refused
beyond ``max_patterns``. All else is distributed: positions are prefix sums of two levels,
over about sqrt(n) hash buckets of each pattern and within a bucket, so a source with a third
of all rows is dealt out like the others.

Null text: size 0. Null source: a source of its own, last. Repeated rows count each; rows that
agree in id and text are interchangeable. Empty table: empty result. Extra columns stay, but
``size``, ``taken`` and ``taken_for`` replace those of the same name. Reruns agree.
"""

from math import ceil, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.work import written

WEIGHTS = (3, 1, 2)


def n_words(text):
    """Runs of other than white space, as a long."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Words for each source: shares by weight, none above ``most`` times its size, the excess dealt again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, open_, rest = {}, order, share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if rest * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: rest * weight[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in full}
        rest = max(0.0, rest - sum(most * sizes[s] for s in full))
        open_ = [s for s in open_ if s not in out]
    return out


def flow(patterns: dict, quotas: dict, repeats: int = 2) -> dict:
    """Words from each pattern to each source: ``patterns`` maps a tuple of sources to its words.

    Cheapest paths one after the other: a path gives a pattern's next words to a source, and may
    move words of other patterns from source to source on its way.
    """
    given = {(p, s): 0 for p in patterns for s in p if s in quotas}
    used, left = dict.fromkeys(patterns, 0), {s: int(q) for s, q in quotas.items()}
    holds: dict = {s: [p for p in patterns if s in p] for s in quotas}
    for cost in range(repeats):
        room = {p: (cost + 1) * patterns[p] - used[p] for p in patterns}
        for start in sorted(patterns, key=str):
            while room[start] > 0:
                came, todo, end = {}, [], ()  # sources are wrapped in tuples, as one may be null
                for s in sorted((s for s in start if s in quotas), key=str):
                    came[s] = ((), start)
                    todo.append(s)
                while todo and not end:  # breadth first: moving words between sources costs nothing
                    s = todo.pop(0)
                    if left[s] > 0:
                        end = (s,)
                        break
                    for p in holds[s]:
                        if given[p, s] > 0:
                            for t in p:
                                if t in quotas and t not in came:
                                    came[t] = ((s,), p)
                                    todo.append(t)
                if not end:
                    break
                path, at = [], end
                while at:
                    before, p = came[at[0]]
                    path.append((before, p, at[0]))
                    at = before
                words = min([room[start], left[end[0]], *(given[p, a[0]] for a, p, _ in path if a)])
                for a, p, b in path:
                    given[p, b] += words
                    if a:
                        given[p, a[0]] -= words
                left[end[0]] -= words
                room[start] -= words
                used[start] += words
    return given


def mix(docs: DataFrame, members: str = "members", size: str = "size", quotas=targets, repeats: int = 2, seed: int = 42, order: tuple = ("doc_id",), max_patterns: int = 100_000) -> tuple[DataFrame, dict, dict]:
    """``docs`` with ``taken`` words and ``taken_for`` (source, words); sizes and targets by source.

    ``members``: array of sources, ``size``: words, ``order``: columns that with the seed fix the order.
    ``docs`` is read twice and should be a table. Quotas are given by a function of the sources' sizes.
    """
    spark = docs.sparkSession
    key, h = F.to_json(F.array_sort(F.array_distinct(members))), F.xxhash64(F.lit(seed), *order)
    rows = docs.drop("taken", "taken_for").withColumns({"_key": key, "_h": h})
    found = rows.groupBy("_key").agg(F.first(F.array_sort(F.array_distinct(members))).alias("m"), F.sum(size).alias("n"), F.count("*").alias("rows")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns, keys = {tuple(r.m or ()): r.n or 0 for r in found}, {tuple(r.m or ()): r["_key"] for r in found}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    goal = quotas(sizes)
    given, laid = flow(patterns, {s: round(t) for s, t in goal.items()}, repeats), []
    for p, n in patterns.items():
        at, spans = 0, []
        for s in sorted(p, key=lambda s: (s is None, s)):
            if words := given.get((p, s), 0):
                spans.append((s, at, at + words))
                at += words
        laid.append((keys[p], n, spans))
    spans = F.broadcast(spark.createDataFrame(laid, "_key string, _all long, _spans array<struct<source: string, start: long, end: long>>"))  # max_patterns rows at most
    n_buckets = max(1, ceil(sqrt(sum(r.rows for r in found))))
    rows = rows.withColumn("_b", F.pmod(F.col("_h"), F.lit(n_buckets)).cast("int"))
    buckets = rows.groupBy("_key", "_b").agg(F.sum(size).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select("_key", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(size).over(Window.partitionBy("_key", "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1))
    at = rows.join(buckets, ["_key", "_b"]).withColumn("_at", F.col("_before") + F.coalesce(within, F.lit(0))).join(spans, "_key", "left")
    n = F.col(size)

    def inside(x):
        each = (F.greatest(F.lit(0), F.least(F.col("_at") + n + F.col("_all") * r, x["end"]) - F.greatest(F.col("_at") + F.col("_all") * r, x["start"])) for r in range(repeats))
        return F.struct(x["source"].alias("source"), sum(each, F.lit(0)).cast("long").alias("words"))

    at = at.withColumn("taken_for", F.filter(F.transform("_spans", inside), lambda x: x["words"] > 0))
    taken = F.aggregate("taken_for", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return at.withColumn("taken", F.coalesce(taken, F.lit(0))).drop("_key", "_h", "_b", "_before", "_at", "_all", "_spans"), sizes, goal


def mix_by_source(docs: DataFrame, source: str = "source", text: str = "text", ident: str = "doc_id", **options) -> tuple[DataFrame, dict, dict]:
    """``mix`` of documents that have one source each; their ids, sources, sizes and words taken."""
    rows = docs.select(F.col(ident), F.col(source), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("_text"))
    return mix(written(rows, "sizes").withColumn("members", F.array(source)), order=(ident, "_text"), **options)


