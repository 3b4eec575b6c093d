"""Chat formatting with linked tool calls (operator 5, DataFrame functions only).

``link_calls`` joins calls and results by (conv_id, call_id), orders calls topologically by
the calls each one follows, validates arguments against schemas and returns one row for each
call; ``format_messages`` adds canonical JSON of every message. No conversation is gathered
in one task: links are equi-joins. Levels of calls that follow one call come from pointer
doubling, whose pointers are written to the shared folder after each of its log2(depth) rounds;
calls that follow several are resolved in rounds over these alone, as many as stand behind
one another.

calls: conv_id, turn, call_id, name, arguments (JSON text), after (a call_id, an array of them or
null). results: conv_id, turn, call_id. schemas: name, field, type, required and optionally one_of
(array of values as text). Types are named as ``schema_of_variant`` names them: STRING, BIGINT,
ARRAY<BIGINT>, OBJECT<a: STRING, b: BIGINT>, ... A row of schemas with null field allows a tool
without arguments.

Defined cases: of repeated calls of one id the first turn holds, the others are kept as
errors ``repeated``; several results: the first turn links, ``n_results`` counts all. A call
after a missing call counts only those that are there and has error ``no_predecessor``; calls on
or behind a cycle have null level and error ``cycle``. Malformed or null arguments: ``not_json``;
anything but an object: ``not_object``; unknown tool: ``no_schema``. Null call_id or conv_id
never links (``no_id``). Canonical JSON has sorted keys and no white space; keys of repeated
names fail as ``not_json``. Texts of any length are kept whole. Extra columns of the inputs are
ignored, except those named in ``keep`` and ``key``. Empty tables give empty tables.

Repeated messages: each gives one row. Messages that agree in ``key`` are taken for one message,
so each holds the distinct calls of that key; where a conversation's turn is not unique, add a
column to ``key`` (and to ``keep``) that tells its messages apart, such as a hash of the text.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.work import written

KEY = ["conv_id", "call_id"]


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, no_predecessor of distinct calls: the longest way from a call that follows none; null on or behind a cycle."""
    after = F.col("after") if calls.schema["after"].dataType.typeName() == "array" else F.array("after")
    ups = calls.select(*KEY, F.explode(F.array_distinct(F.array_compact(after))).alias("up"))
    ids = calls.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("_there"))
    ups = written(ups.join(ids, ["conv_id", "up"], "left"), "links")
    sums = ups.groupBy(*KEY).agg(F.count("_there").alias("_n"), F.min(F.when(F.col("_there"), F.col("up"))).alias("_up"), (F.count("*") > F.count("_there")).alias("no_predecessor"))
    one = F.col("_n") == 1
    at = calls.select(*KEY).join(sums, KEY, "left").select(
        *KEY, F.when(one, F.col("_up")).alias("up"), F.when(one, 1).otherwise(0).cast("long").alias("far"),
        F.when(F.coalesce(one, F.lit(False)), F.lit(None)).otherwise(F.col("call_id")).alias("anchor"), F.coalesce(F.col("_n") > 1, F.lit(False)).alias("several"), F.coalesce("no_predecessor", F.lit(False)).alias("no_predecessor"),
    )
    at, left = written(at, "levels"), None
    while (open_ := at.where("up IS NOT NULL").count()) and open_ != left:
        left = open_
        above = at.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"), F.col("anchor").alias("_anchor"))
        at = at.join(above, ["conv_id", "up"], "left").select(*KEY, F.col("_up").alias("up"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.coalesce("anchor", "_anchor").alias("anchor"), "several", "no_predecessor")
        at = written(at, "levels")
    # calls that follow several: from the anchors of those, when all are known
    known = at.where("anchor = call_id AND NOT several").select(*KEY, F.lit(0).cast("long").alias("level"))
    if at.where("several").limit(1).count():
        before = at.select("conv_id", F.col("call_id").alias("up"), "anchor", "far")
        links = ups.join(at.where("several").select(*KEY), KEY).where("_there").join(before, ["conv_id", "up"]).select(*KEY, "anchor", (F.col("far") + 1).alias("far"))
        links, known, n = written(links, "links"), written(known, "levels"), None
        while n is None or n:
            there = known.select("conv_id", F.col("call_id").alias("anchor"), "level")
            found = links.join(known, KEY, "left_anti").join(there, ["conv_id", "anchor"], "left").groupBy(*KEY).agg(F.max(F.col("level") + F.col("far")).alias("level"), F.min(F.col("level").isNotNull()).alias("_all"))
            found = written(found.where("_all").select(*KEY, "level"), "levels")
            known, n = known.unionByName(found), found.count()
    known = known.select("conv_id", F.col("call_id").alias("anchor"), "level")
    return at.join(known, ["conv_id", "anchor"], "left").select(*KEY, (F.col("level") + F.col("far")).alias("level"), "no_predecessor")


def _checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with canonical ``args`` and what is wrong with them."""
    one_of = F.col("one_of") if "one_of" in schemas.columns else F.lit(None).cast("array<string>").alias("one_of")
    rules = schemas.groupBy("name").agg(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "type", "required", one_of))).alias("_fields"))  # a tool has few fields
    v = F.expr("try_parse_json(arguments)")
    calls = calls.join(rules, "name", "left").withColumn("_v", v).withColumn("_kind", F.expr("schema_of_variant(_v)"))
    calls = calls.withColumn("_m", F.expr("CASE WHEN _kind LIKE 'OBJECT%' THEN CAST(_v AS MAP<STRING, VARIANT>) END"))
    bad = F.expr(
        """transform(filter(_fields, f -> CASE WHEN element_at(_m, f.field) IS NULL THEN f.required
             ELSE schema_of_variant(element_at(_m, f.field)) <> f.type OR NOT coalesce(array_contains(f.one_of, try_variant_get(element_at(_m, f.field), '$', 'string')), true) END), f -> concat('field:', f.field))"""
    )
    more = F.expr("transform(filter(array_sort(map_keys(_m)), k -> NOT exists(_fields, f -> f.field = k)), k -> concat('unknown:', k))")
    wrong = (
        F.when(F.col("_fields").isNull(), F.array(F.lit("no_schema")))
        .when(F.col("_v").isNull(), F.array(F.lit("not_json")))
        .when(F.col("_m").isNull(), F.array(F.lit("not_object")))
        .otherwise(F.concat(bad, more))
    )
    return calls.withColumns({"_wrong": wrong, "args": F.expr("to_json(_v)")}).drop("_v", "_kind", "_m", "_fields")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, keep: tuple = ()) -> DataFrame:
    """conv_id, turn, call_id, name, args, level, result_turn, n_results, errors of each row of ``calls``, and its columns ``keep``."""
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after", *keep)
    firsts = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*KEY).agg(
        F.min(F.struct("turn", "after")).alias("f"), F.count("*").alias("_n")
    ).select(*KEY, F.col("f.turn").alias("_first"), F.col("f.after").alias("after"), "_n")
    firsts = written(firsts, "calls")
    linked = results.groupBy(*KEY).agg(F.min("turn").alias("result_turn"), F.count("*").alias("n_results"))
    facts = firsts.join(levels(firsts), KEY, "left").join(linked, KEY, "left").drop("after")
    out = _checked(calls, schemas).join(facts, KEY, "left")
    error = lambda c, name: F.when(c, F.lit(name))
    found = F.array_compact(F.array(
        error(F.col("_n").isNull(), "no_id"), error(F.col("turn") > F.col("_first"), "repeated"), error(F.col("no_predecessor"), "no_predecessor"),
        error(F.col("_n").isNotNull() & F.col("level").isNull(), "cycle"), error(F.col("result_turn").isNull(), "no_result"), error(F.col("result_turn") < F.col("turn"), "result_before_call"),
    ))
    return out.select("conv_id", "turn", "call_id", "name", "args", "level", "result_turn", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.concat(found, "_wrong").alias("errors"), *keep)


def format_messages(messages: DataFrame, linked: DataFrame, key: tuple = ("conv_id", "turn")) -> DataFrame:
    """One row for each of ``messages`` (conv_id, turn, role, text): ``calls``, the linked calls it holds, and canonical ``json``.

    Messages and calls meet by ``key``. Calls are in order of id, name and arguments, which are an object in the JSON. Keys of the
    JSON are sorted; null values and an empty list of calls are left out.
    """
    m = messages.select("conv_id", "turn", "role", "text", *[c for c in key if c not in ("conv_id", "turn", "role", "text")])
    call = F.struct("call_id", "name", "args", "level", "result_turn", "n_results", "errors")
    held = linked.groupBy(*key).agg(F.array_sort(F.collect_set(call)).alias("calls"))  # of one message
    df = m.join(held, list(key), "left")
    shown = F.transform("calls", lambda c: F.struct(F.try_parse_json(c["args"]).alias("arguments"), c["call_id"].alias("id"), c["level"].alias("level"), c["name"].alias("name"), c["result_turn"].alias("result")))
    df = df.withColumn("calls", F.coalesce("calls", F.lit([]).cast(held.schema["calls"].dataType)))
    return df.withColumn("json", F.to_json(F.struct(F.when(F.size("calls") > 0, shown).alias("calls"), F.col("text").alias("content"), "role", "turn")))
