"""Queries of the training-data operators and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat_format, filter_audit, lexical_packing, license_scan, merkle, order_minhash, passage_chains, quality_rules, sharding, simhash, source_mix, suffix_dedup, url_filters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_rules.judge(quality_rules.ledger(docs), "2026-1")
    base = F.col("failed_bits").bitwiseAND(F.lit(quality_rules.POLICIES["base"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits")


OP10_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l FROM documents),
wins AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 7, 0))) AS i FROM t),
keyed AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], ' ') AS s FROM wins),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM keyed) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM twice) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN cover c ON c.doc_id = t.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
        + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM f
"""

URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP8_SQL = r"""
WITH r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
m AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p) AS k
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND k = 1
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is a call of tool ``reply`` that follows the user turn two before it; the next assistant turn is its result."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.xxhash64("role", "text").alias("message"))
    ident = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    calls = m.where("role = 'user'").select(
        "conv_id", "turn", "message", ident(turn).alias("call_id"), F.replace("role", F.lit("user"), F.lit("reply")).alias("name"),
        F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("prompt"))).alias("arguments"), F.when(turn >= 2, ident(turn - 2)).alias("after"),
    )
    results = m.where("role = 'assistant'").select("conv_id", "turn", ident(turn - 1).alias("call_id"))
    schemas = spark.createDataFrame([("reply", "prompt", "STRING", True), ("reply", "turn", "BIGINT", True)], "name string, field string, type string, required boolean")
    linked = chat_format.link_calls(calls, results, schemas, keep=("message",))
    rows = chat_format.format_messages(m, linked, ("conv_id", "turn", "message")).withColumn("call", F.get("calls", F.lit(0)))
    return rows.select("conv_id", "turn", "role", "call.call_id", "call.level", "call.result_turn", "call.n_results", F.array_join("call.errors", ",").alias("errors"), "json")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sizes, goal = source_mix.mix_by_source(table(spark, sf_dir, "documents"))
    facts = spark.createDataFrame([(s, n, float(goal[s])) for s, n in sizes.items()], "s string, source_size long, target double")  # one row for each source, bounded by the mix
    rows = rows.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("s")), "left")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumn("licenses", F.array_join("licenses", ","))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_chains.passages(table(spark, sf_dir, "documents"))


def op7_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lexical_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT t AS first_text, min(doc_id) AS first_id FROM t GROUP BY t),
p AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
              + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
              + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN t.doc_id > first_id THEN 16 ELSE 0 END)::INT AS bits
      FROM t JOIN m ON t = first_text LEFT JOIN g ON g.doc_id = t.doc_id),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM p GROUP BY part, bits),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, step::INT AS step, bs[step]::INT AS bit, coalesce(list_sum(bs[1 : step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, step, sum(CASE WHEN bits & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN bits & bit <> 0 AND bits & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN bits = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN bits & bit <> 0 THEN n * (120 // bit_count(bits)) ELSE 0 END)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.interleave(sharding.described(table(spark, sf_dir, "documents")), 40, "rows")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_source_mix, op2_order_minhash, op3_license_scan, op4_simhash, op5_chat_format, op6_passage_chains, op7_lexical_packing, op8_url_filters, op9_suffix_dedup, op10_quality_rules, op11_filter_audit, op12_sharding, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filters": OP8_SQL, "op10_quality_rules": OP10_SQL, "op11_filter_audit": OP11_SQL}
