"""Quality rules as a ledger of failure bits (operator 10, DataFrame functions only).

``ledger`` evaluates every rule once for each row and stores the failure bits beside the
measurements. ``judge`` applies a versioned policy, which is a bit mask, without reading
texts again; ``ablations`` counts by bitwise aggregation what each rule rejects, alone and
at all, and what a policy would keep without it.

A null text counts as empty. Repeated rows and ids are judged row by row. Columns of the
input stay, except that ``failed_bits`` and the measurements replace any of the same name.
An empty table gives an empty table. Nothing is shuffled by ``ledger`` and ``judge``.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.work import SPACES, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Bit, name and failing condition of each rule; a bit keeps its meaning for ever.
RULES = (
    (0, "few_words", "n_words < 20"),
    (1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 20 * n_words"),
)

#: Policies by version: a document is kept if none of the mask's bits is set.
POLICIES = {"base": 0b000011, "2025-1": 0b000111, "2026-1": 0b111111}


def _measured(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    n = F.col("_n")
    df = docs.drop(*MEASURES, "failed_bits")
    kept = [F.col(f"`{c}`") for c in df.columns]
    df = df.withColumns({"_w": words(F.col(text)), "_l": lines})
    df = df.withColumns({"_n": F.size("_w"), "_h": F.transform("_w", lambda w: F.xxhash64(w))})
    hashed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)]))
    df = df.withColumn("_h", F.when(n > WINDOW, hashed))
    # equal windows have equal hashes: texts whose hashes all differ have no repeat, the others compare words
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    keyed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.array_join(F.slice("_w", i + 1, WINDOW), " ").alias("s"), i.alias("i")))
    df = df.withColumn("_k", F.when(again, F.array_sort(keyed)))

    def twice(x, j):
        return (F.get("_k", j - 1)["s"] == x["s"]) | F.coalesce(F.get("_k", j + 1)["s"] == x["s"], F.lit(False))

    starts = F.array_sort(F.transform(F.filter("_k", lambda x, j: F.coalesce(twice(x, j), F.get("_k", j + 1)["s"] == x["s"], F.lit(False))), lambda x: x["i"]))
    df = df.withColumn("_s", starts)
    m = F.size("_s")
    steps = F.zip_with(F.slice("_s", F.lit(2), m - 1), F.slice("_s", F.lit(1), m - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.col("_s").isNull() | (m < 1), F.lit(0)).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda a, x: a + x))
    measures = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": covered,
    }
    # a generator, as later filters would otherwise move into the expressions and evaluate them again and again
    once = F.explode(F.array(F.struct(*[m.cast("long").alias(name) for name, m in measures.items()])))
    return df.select(*kept, once.alias("_m")).select(*kept, *[F.col(f"_m.{name}").alias(name) for name in measures])


def ledger(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` with the measurements and ``failed_bits`` (long)."""
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, _, rule in rules]
    return _measured(docs, text).withColumn("failed_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def judge(rows: DataFrame, version: str, policies=POLICIES) -> DataFrame:
    """``rows`` of a ledger with ``kept``: no bit of the policy's mask is set."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policies[version])) == 0)


def ablations(rows: DataFrame, version: str, rules=RULES, policies=POLICIES) -> DataFrame:
    """One row for each rule of the policy: documents that fail it, that only it rejects, and that stay without it."""
    mask = policies[version]
    masked = rows.select(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("b"))
    counts = masked.groupBy("b").agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("m")) for bit, name, _ in rules if mask >> bit & 1])).alias("r")
    flat = counts.select("b", "n", each).select("b", "n", "r.rule", "r.m")
    b, m = F.col("b"), F.col("m")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return flat.groupBy("rule").agg(
        total(b.bitwiseAND(m) != 0)("n_failed"), total(b == m)("n_only"), total((b == 0) | (b == m))("n_kept_without"), total(b == 0)("n_kept"),
    )
