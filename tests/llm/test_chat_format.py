import json
import random

from pyspark.sql import functions as F

from millrace.llm import chat_format as c
from millrace.llm.queries import queries
from oracle import SF

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after string"


def test_links_levels_and_errors(spark):
    rows = [
        (1, 0, "a", "add", '{"y": 2, "x": 1}', None), (1, 1, "b", "add", '{"x": "one", "y": 2, "z": {"q": 1, "b": [3]}}', "a"), (1, 2, "c", "add", "{bad", "b"), (1, 3, "a", "add", '{"x":1,"y":2}', None),
        (2, 0, "a", "add", "[1]", "b"), (2, 1, "b", "none", "{}", "a"), (2, 2, "d", "add", None, "zz"), (3, 0, None, "add", '{"x":1,"y":2}', None), (4, 5, "x", "add", '{"y": 2}', None),
    ]
    results = [(1, 5, "a"), (1, 6, "a"), (1, 1, "c"), (4, 2, "x"), (None, 1, "a"), (9, 9, "a")]
    schemas = [("add", "x", "BIGINT", True), ("add", "y", "BIGINT", False)]
    linked = c.link_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame(results, "conv_id long, turn long, call_id string"), spark.createDataFrame(schemas, "name string, field string, type string, required boolean"))
    got = {(r.conv_id, r.turn): r for r in linked.collect()}
    assert len(got) == len(rows)
    assert got[1, 0].errors == [] and got[1, 0].args == '{"x":1,"y":2}' and got[1, 0].result_turn == 5 and got[1, 0].n_results == 2 and got[1, 0].level == 0
    assert got[1, 1].level == 1 and got[1, 1].errors == ["no_result", "field:x", "unknown:z"] and got[1, 1].args == '{"x":"one","y":2,"z":{"b":[3],"q":1}}'
    assert got[1, 2].level == 2 and got[1, 2].errors == ["result_before_call", "not_json"]
    assert got[1, 3].errors == ["repeated"]
    assert got[2, 0].level is None and "cycle" in got[2, 0].errors and "not_object" in got[2, 0].errors
    assert "no_schema" in got[2, 1].errors
    assert got[2, 2].level == 0 and got[2, 2].errors == ["no_predecessor", "no_result", "not_json"]
    assert "no_id" in got[3, 0].errors
    assert got[4, 5].errors == ["result_before_call", "field:x"]


def test_long_chain(spark):
    rows = [(1, k, str(k), str(k - 1) if k else None) for k in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, after string")
    assert {int(r.call_id): r.level for r in c.levels(df).collect()} == {k: k for k in range(200)}


def test_messages(spark):
    m = spark.createDataFrame([(1, 0, "user", 'say "hé"\n'), (1, 1, "tool", None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    linked = c.link_calls(spark.createDataFrame([(1, 0, "a", "t", "{}", None)], CALLS), spark.createDataFrame([(1, 1, "a")], "conv_id long, turn long, call_id string"), spark.createDataFrame([("t", None, None, None)], "name string, field string, type string, required boolean"))
    got = {r.turn: r.json for r in c.format_messages(m, linked).collect()}
    assert json.loads(got[0]) == {"calls": [{"arguments": {}, "id": "a", "level": 0, "name": "t", "result": 1}], "content": 'say "hé"\n', "role": "user", "turn": 0}
    assert got[1] == '{"role":"tool","turn":1}' and got[None] == "{}"
    none = spark.createDataFrame([], CALLS)
    assert c.link_calls(none, m.selectExpr("conv_id", "turn", "'x' call_id").where("false"), spark.createDataFrame([], "name string, field string, type string, required boolean")).count() == 0


def brute_levels(after):
    """Longest way back; None on or behind a cycle."""

    def level(c, seen):
        if c in seen:
            return None
        ups = [level(u, seen | {c}) for u in after[c] if u in after]
        return None if None in ups else 1 + max(ups, default=-1)

    return {c: level(c, frozenset()) for c in after}


def test_several_predecessors(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(6):
        after = {str(k): rng.sample([str(j) for j in range(max(0, k - 6), k + (conv % 3 == 2) * 2)] or ["x"], k=min(rng.choice([0, 1, 1, 1, 2, 3]), max(1, min(k, 6)))) for k in range(25)}
        rows += [(conv, c, ups) for c, ups in after.items()]
        want |= {(conv, c): (n, any(u not in after for u in after[c])) for c, n in brute_levels(after).items()}
    df = spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")
    assert {(r.conv_id, r.call_id): (r.level, r.no_predecessor) for r in c.levels(df).collect()} == want
    assert {n for n, _ in want.values()} >= {None, 0, 1, 2, 3}


def test_nested_schemas(spark):
    schemas = spark.createDataFrame([("t", "at", "OBJECT<city: STRING, zip: BIGINT>", True, None), ("t", "unit", "STRING", False, ["C", "F"]), ("t", "days", "ARRAY<BIGINT>", False, None)], "name string, field string, type string, required boolean, one_of array<string>")
    given = ['{"at":{"zip":1,"city":"x"},"unit":"C","days":[1,2]}', '{"at":{"city":"x"},"unit":"K"}', '{"days":["a"],"at":{"city":"x","zip":1}}']
    calls = spark.createDataFrame([(1, k, str(k), "t", a, None) for k, a in enumerate(given)], CALLS)
    got = {r.turn: r for r in c.link_calls(calls, spark.createDataFrame([(1, 9, str(k)) for k in range(3)], "conv_id long, turn long, call_id string"), schemas).collect()}
    assert [got[k].errors for k in range(3)] == [[], ["field:at", "field:unit"], ["field:days"]]
    assert got[0].args == '{"at":{"city":"x","zip":1},"days":[1,2],"unit":"C"}'


def test_repeated_messages_give_a_row_each(spark):
    """Ten copies of a turn, other texts of the same turn, parallel calls, clashing extra columns, long texts."""
    texts = ["same"] * 10 + ["other", "x" * 200_000] + ["last"] * 10
    m = spark.createDataFrame([(1, 0, "user", t, "k", 7) for t in texts], "conv_id long, turn long, role string, text string, calls string, json int").withColumn("message", F.xxhash64("text"))
    calls = m.select("conv_id", "turn", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("call_id"), F.lit("t").alias("name"), F.to_json(F.struct("text")).alias("arguments"), F.lit(None).cast("string").alias("after"), "message")
    schemas = spark.createDataFrame([("t", "text", "STRING", True)], "name string, field string, type string, required boolean")
    none = spark.createDataFrame([], "conv_id long, turn long, call_id string")
    linked = c.link_calls(calls, none, schemas, keep=("message",))
    assert linked.count() == 2 * len(texts)
    rows = c.format_messages(m, linked, ("conv_id", "turn", "message")).collect()
    assert sorted(r.text for r in rows) == sorted(texts)
    for r in rows:
        got = json.loads(r.json)
        assert got["content"] == r.text and [x["id"] for x in got["calls"]] == ["a", "b"] and all(x["arguments"] == {"text": r.text} for x in got["calls"])


def test_query_keeps_every_message(spark):
    m = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = queries()["op5_chat_format"](spark, SF).collect()
    by_conv = {}
    for r in m.collect():
        by_conv.setdefault(r.conv_id, {}).setdefault(r.turn, []).append(r)
    assert len(rows) == m.count()
    for r in rows:
        got = json.loads(r.json)
        assert got["turn"] == r.turn and got["role"] == r.role
        if r.role != "user":
            assert r.call_id is None and "calls" not in got
            continue
        turns, at, level = by_conv[r.conv_id], r.turn, 0
        while at >= 2 and any(x.role == "user" for x in turns.get(at - 2, [])):
            at, level = at - 2, level + 1
        assert r.call_id == f"call-{r.conv_id}-{r.turn}" and r.level == level
        assert [c_["arguments"] for c_ in got["calls"]] == [{k: v for k, v in (("prompt", got.get("content")), ("turn", r.turn)) if v is not None}]
        answers = [x for x in turns.get(r.turn + 1, []) if x.role == "assistant"]
        assert r.n_results == len(answers) and r.result_turn == (r.turn + 1 if answers else None)
