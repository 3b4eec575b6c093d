"""How filters interact: what each removes alone, after others, in every order (operator 11).

A relational word pipeline. Words are exploded and counted by (document, word), then by document for totals and distincts;
flags of whole texts and of copies are joined to them. Each document then has a pattern of failed filters, one bit a filter,
and every question about orders is a sum over 32 conditional counts: a filter removes what fails it and nothing before it.

A document here is an id with a text: rows equal in both are one with a number of copies, so their words are read once.
Texts are known by 128 bits of their SHA-256. Copies of a text are added up before their smallest id is sought, so that no
group of copies meets in one task. A null text is empty; a null id is greater than any other, and null ids are not smaller
than each other; a null part counts as the empty string. Labels of an id that has several hold if any of them does; null ids
have none. Very long texts are one document like any other. An empty table gives no rows. Further columns are not read.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.work import words, written

FILTERS = "ABCDE"
PATTERNS = 1 << len(FILTERS)
#: Classes of documents by label column; counts of each are given beside those of all documents.
CLASSES = {"all": None, "good": "quality", "toxic": "toxic"}


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _digest() -> Column:
    return F.substring(F.unhex(F.sha2(_text(), 256)), 1, 16).alias("digest")


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_words, n_distinct of each id and text that has words."""
    once = docs.groupBy("doc_id", _digest()).agg(F.first("text").alias("text"))  # copies meet in the task that reads them
    each = once.select("doc_id", "digest", F.explode(words(F.col("text"))).alias("word"))
    # the texts are dealt by document: neither of the two sums moves rows again
    return each.groupBy("doc_id", "digest", "word").agg(F.count("*").alias("n")).groupBy("doc_id", "digest").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def text_flags(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, digest, part, C and D (bits of failed filters), copies."""
    t = _text()
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bits = F.when(100 * capitals > 10 * F.length(t), 4).otherwise(0) + F.when(t.rlike("[#$%&*|]"), 8).otherwise(0)
    rows = docs.select("doc_id", _digest(), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("bits"))
    return rows.groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("copies"))


def patterns(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, pattern (int, a bit for each failed filter), quality, toxic (boolean), n: documents, added up."""
    counted = word_counts(docs).withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    rows = text_flags(docs, part).join(counted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    rows = rows.withColumn("bits", F.col("bits") + F.when(n < 100, 1).otherwise(0) + F.when(100 * distinct < 80 * n, 2).otherwise(0))
    held = labels.groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in CLASSES.values() if c])
    rows = rows.select("doc_id", "digest", "part", "bits", "copies").join(held, "doc_id", "left").fillna(0, ["quality", "toxic"])
    # each id is once in a group: the least is the one that other texts of the group are copies of
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "copies")).alias("least")
    grouped = written(rows.groupBy("digest", "part", "bits", "quality", "toxic").agg(F.sum("copies").alias("n"), least), "flags")  # read twice
    first = F.struct("least.none", "least.doc_id")
    firsts = grouped.groupBy(F.col("digest").alias("_digest")).agg(F.min(first).alias("first"))
    kept = F.when(first.eqNullSafe(F.col("first")), F.col("least.copies")).otherwise(0)
    both = F.explode(F.array(F.struct(F.lit(0).alias("e"), kept.alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - kept).alias("n")))).alias("x")
    return grouped.join(firsts, F.col("digest") == F.col("_digest")).select("part", "bits", "quality", "toxic", both).where("x.n > 0").groupBy(
        "part", (F.col("bits") + F.col("x.e")).cast("int").alias("pattern"), (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic")
    ).agg(F.sum("x.n").alias("n"))


def pattern_counts(rows: DataFrame) -> DataFrame:
    """A row for each part with an array for each class: the 32 conditional counts by pattern, zeros included."""
    classes = F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(name)) if c else F.lit(name) for name, c in CLASSES.items()]))).alias("class")
    wide = rows.select("part", "pattern", "n", classes).groupBy("part", "class").agg(
        *[F.coalesce(F.sum(F.when(F.col("pattern") == p, F.col("n"))), F.lit(0)).alias(f"n{p}") for p in range(PATTERNS)]
    )
    arrays = wide.select("part", "class", F.array(*[f"n{p}" for p in range(PATTERNS)]).alias("counts"))
    none = F.array_repeat(F.lit(0).cast("long"), PATTERNS)
    return arrays.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("class") == name, F.col("counts"))), none).alias(name) for name in CLASSES])


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """filter_order, step, the filter's bit and the bits of those before it, for every order and step."""
    out = []
    for order in permutations(filters):
        bits = [1 << filters.index(f) for f in order]
        out += [("".join(order), k + 1, bit, sum(bits[:k])) for k, bit in enumerate(bits)]
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row for each part, order of filters and step with the counts of what is kept, removed and lost there."""
    docs = docs.select("doc_id", "text", part)
    counts = pattern_counts(patterns(docs, labels.select("doc_id", "quality", "toxic"), part))
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, bit int, before int")  # 600 rows, whatever the input
    places = F.sequence(F.lit(0), F.lit(PATTERNS - 1))

    def total(of: str, which) -> Column:
        return F.aggregate(F.filter(places, which), F.lit(0).cast("long"), lambda a, p: a + F.get(of, p))

    has = lambda p, bits: p.bitwiseAND(F.col(bits)) != 0
    removed = lambda of: total(of, lambda p: has(p, "bit") & ~has(p, "before"))
    # of n! orders, a filter is the first of k failed ones in n! / k
    shapley = F.aggregate(F.filter(places, lambda p: has(p, "bit")), F.lit(0).cast("long"), lambda a, p: a + F.get("all", p) * F.element_at(F.lit([120 // k for k in range(1, len(FILTERS) + 1)]), F.bit_count(p)))
    return counts.crossJoin(F.broadcast(steps)).select(
        "part", "filter_order", "step", total("all", lambda p: ~has(p, "bit") & ~has(p, "before")).alias("kept"), removed("all").alias("removed"),
        total("all", lambda p: has(p, "bit") & has(p, "before")).alias("redundant"), F.get("all", F.col("bit")).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )
