"""Tool calls whose JSON holds half surrogate pairs, and schemas with patterns that backtracking takes for ever on."""

import json
import time

from graphloom.llm import toolcalls


def test_half_surrogates_are_malformed(spark):
    call = '<tool_call>{"name": "f", "id": "%s", "arguments": {"x": "%s"}}</tool_call>'
    rows = [
        (1, 1, "assistant", call % ("a", "\\ud800")), (1, 2, "assistant", call % ("\\udc00b", "y")), (1, 3, "assistant", call % ("c", "\\ud83d\\ude00")),
        (1, 4, "tool", '{"tool_call_id": "c", "content": "\\ud800"}'), (1, 0, "system", '<tools>[{"name": "f", "parameters": {"required": ["\\ud800"]}}]</tools>'),
    ]
    got = {r.turn: r for r in toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.part != "text"}
    assert [got[k].status for k in (0, 1, 2, 4)] == ["malformed"] * 4
    assert got[3].status == "unknown_tool" and "😀" in got[3].json
    schemas = spark.createDataFrame([("f", '{"required": ["\\ud800"]}')], "name string, schema string")
    assert [r.status for r in toolcalls.link(spark.createDataFrame(rows[2:3], "conv_id long, turn long, role string, text string"), schemas=schemas).collect()] == ["bad_schema"]


def test_patterns_take_linear_time():
    began = time.time()
    for pattern in ("(a+)+$", "(a|aa)+$", "(.*)*b$"):
        assert toolcalls.problems("a" * 5000 + "!", {"pattern": pattern}) == ["$: pattern"]
    assert toolcalls.problems({"aaa": 1}, {"patternProperties": {"^(a+)+$": {"type": "string"}}}) == ["$.aaa: not string"]
    assert time.time() - began < 2
    assert toolcalls.problems("x12", {"pattern": "[0-9]{2}$"}) == [] and toolcalls.problems("漢字", {"pattern": "^.字$"}) == []
    assert not toolcalls.well_formed({"pattern": "("}) and not toolcalls.well_formed({"pattern": r"(a)\1"})
    assert toolcalls.judged(json.dumps("b"), '{"pattern": "^a"}') == (False, ["$: pattern"])
