"""A training corpus from ``documents``: rules, near and exact dedup, mixing, packing.

Every stage works row by row or by id and text: null ids, texts and sources, empty and very long texts, repeated rows,
empty tables and further columns (which are left out) are taken; each function states what becomes of them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import lexical_packing, near_copies, quality_rules, source_mix, suffix_dedup
from millrace.llm.work import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts go (too few words); repeated rows are judged each; null ids stay."""
    return quality_rules.judge(quality_rules.ledger(docs.select(*COLUMNS)), "2026-1").where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard of 0.8 or more) one document: that of the smallest id, null ids last; of its rows with one text the least.

    Texts without words, null ones included, are copies of each other.
    """
    return near_copies.distinct_texts(docs.select(*COLUMNS)).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those of which nothing stays go.

    Null ids are later than any other; rows of equal id keep what they share; null texts become empty.
    """
    rows = suffix_dedup.cleaned(docs.select(*COLUMNS))
    return rows.where("n_removed = 0 OR text <> ''").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words, to the nearest whole time.

    Documents without words have none to take and go. A null source is one of its own; repeated rows count each.
    """
    rows = docs.select(*COLUMNS).withColumns({"size": source_mix.n_words(F.col("text")), "members": F.array("source"), "_text": F.xxhash64("text")})
    mixed, _, _ = source_mix.mix(rows, order=("doc_id", "_text"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return mixed.withColumn("_times", times).where("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; each row is packed, null texts as empty ones, null ids stay null."""
    import public_tokenizers

    return lexical_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("suffix_dedup", exact_dedup), ("source_mix", mixing), ("lexical_packing", packing)]

#: Components, dedup and packing are beyond SQL; tests hold each stage against a plain version over all pairs, strings or rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
