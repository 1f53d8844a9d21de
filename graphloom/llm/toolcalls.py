"""Tool-call linking: calls and results joined by identifier, ordered, validated, canonical.

A message's text may hold calls, ``<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>``
(also ``"depends_on": [ids]``; an argument ``{"$ref": id}`` depends on that call too), and a message of
role ``tool`` holds ``{"tool_call_id": ..., "content": ...}``. A system message may declare tools,
``<tools>[{"name": ..., "parameters": schema}]</tools>``. Messages are parsed in Arrow batches; calls meet
their schemas by a hash join on (conversation, name) and results meet calls by one on (conversation,
identifier). Order: a message comes after the calls it needs. Each message gets ``order_turn`` (the latest
turn among itself and what it needs, transitively) and ``order_depth`` (the length of the chain of calls
behind it), so sorting by ``order_turn, order_depth, turn`` is topological and leaves ordered
conversations as they are. A message is one row of canonical JSON (keys sorted, no spaces, numbers in
shortest form), so no conversation is gathered into one task, however long.

Defined results for odd rows: a null text counts as empty, a null role is ``user``, a null conversation is
one of its own, a null turn sorts first; calls that repeat an identifier keep the first (by turn, then
text) and mark the others ``duplicate``; results without a call are ``orphan``, calls without a result
``pending``, malformed blocks ``malformed``, calls on or behind a cycle of dependencies, and their results,
``cycle`` (they keep their place); tools without a schema are ``unknown_tool``, those whose schema isn't well
formed or has keywords outside KEYWORDS ``bad_schema``; of several declarations of a tool the first holds (by
turn, then text); JSON that escapes half a surrogate pair is malformed (in a schema: bad); repeated rows each get their row; other columns are neither read nor returned; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, written

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)
TOOLS = re.compile(r"<tools>(.*?)</tools>", re.DOTALL)


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, and whole floats as integers; what JSON can't hold is refused."""

    def plain(v: object) -> object:
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("not a JSON number")
            return int(v) if v.is_integer() and abs(v) < 1 << 53 else v
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


def _number(v: object) -> bool:
    return _TYPES["number"](v)


def _size(v: object) -> bool:
    return _TYPES["integer"](v) and v >= 0


def _names(v: object) -> bool:
    return isinstance(v, list) and all(isinstance(x, str) for x in v)


@lru_cache(4096)
def _compiles(pattern: str) -> bool:
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
        return True
    except (pa.ArrowInvalid, UnicodeError):
        return False


def _pattern(v: object) -> bool:
    return isinstance(v, str) and _compiles(v)


def _matches(pattern: str, value: str) -> bool:
    """Whether the pattern occurs, by an automaton: time grows with the value's length, whatever the pattern."""
    return pc.match_substring_regex(pa.array([value]), pattern)[0].as_py()


def _schemas(v: object) -> bool:
    return isinstance(v, list) and len(v) > 0 and all(map(well_formed, v))


# Keywords of JSON Schema, with what each must hold. Those that only describe hold anything.
KEYWORDS = {
    "type": lambda v: isinstance(v, str) and v in _TYPES or _names(v) and len(v) > 0 and set(v) <= set(_TYPES),
    "enum": lambda v: isinstance(v, list),
    "const": lambda v: True,
    "properties": lambda v: isinstance(v, dict) and all(map(well_formed, v.values())),
    "patternProperties": lambda v: isinstance(v, dict) and all(map(_pattern, v)) and all(map(well_formed, v.values())),
    "additionalProperties": lambda v: well_formed(v),
    "required": _names,
    "items": lambda v: well_formed(v),
    "anyOf": _schemas,
    "oneOf": _schemas,
    "allOf": _schemas,
    "not": lambda v: well_formed(v),
    "pattern": _pattern,
    "uniqueItems": lambda v: isinstance(v, bool),
    "multipleOf": lambda v: _number(v) and v > 0,
    **dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"), _number),
    **dict.fromkeys(("minItems", "maxItems", "minLength", "maxLength", "minProperties", "maxProperties"), _size),
    **dict.fromkeys(("title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment"), lambda v: True),
}


def well_formed(schema: object) -> bool:
    """Whether ``problems`` can judge by the schema: it has known keywords only, and each holds what it must."""
    return isinstance(schema, bool) or isinstance(schema, dict) and all(k in KEYWORDS and KEYWORDS[k](v) for k, v in schema.items())


def problems(value: object, schema: object, at: str = "$") -> list[str]:
    """What of ``value`` breaks a well-formed schema, place by place."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: nothing is allowed"]
    if isinstance(value, dict) and "$ref" in value and len(value) == 1:
        return []  # the value of another call, known only when it has run
    found = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]

    def check(broken: bool, what: str) -> None:
        if broken:
            found.append(f"{at}: {what}")

    own = canonical(value)
    check("enum" in schema and own not in map(canonical, schema.get("enum", [])), "not in enum")
    check("const" in schema and own != canonical(schema.get("const")), "not the constant")
    for part in schema.get("allOf", []):
        found += problems(value, part, at)
    check("anyOf" in schema and all(problems(value, part, at) for part in schema.get("anyOf", [])), "none of anyOf")
    check("oneOf" in schema and sum(not problems(value, part, at) for part in schema.get("oneOf", [])) != 1, "not one of oneOf")
    check("not" in schema and not problems(value, schema.get("not", True), at), "what must not be")
    if isinstance(value, dict):
        known, by_pattern = schema.get("properties", {}), schema.get("patternProperties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        check(len(value) < schema.get("minProperties", 0), "too few")
        check(len(value) > schema.get("maxProperties", math.inf), "too many")
        for k, v in value.items():
            rules = ([known[k]] if k in known else []) + [rule for pattern, rule in by_pattern.items() if _matches(pattern, k)]
            for rule in rules or [schema.get("additionalProperties", True)]:
                found += problems(v, rule, f"{at}.{k}")
    elif isinstance(value, list):
        found += [x for k, v in enumerate(value) for x in problems(v, schema.get("items", True), f"{at}[{k}]")]
        check(len(value) < schema.get("minItems", 0), "too few")
        check(len(value) > schema.get("maxItems", math.inf), "too many")
        check(schema.get("uniqueItems", False) and len(set(map(canonical, value))) < len(value), "repeated items")
    elif isinstance(value, str):
        check(len(value) < schema.get("minLength", 0), "too short")
        check(len(value) > schema.get("maxLength", math.inf), "too long")
        check("pattern" in schema and not _matches(schema.get("pattern", ""), value), "pattern")
    elif _number(value):
        check(value < schema.get("minimum", -math.inf) or value <= schema.get("exclusiveMinimum", -math.inf), "under minimum")
        check(value > schema.get("maximum", math.inf) or value >= schema.get("exclusiveMaximum", math.inf), "over maximum")
        check("multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema.get("multipleOf", 1))) != 0, "not a multiple")
    return found


def judged(content: str, schema: str | None) -> tuple[bool, list[str]]:
    """Whether the schema is bad, and the problems of the arguments; both as JSON. Without a schema nothing is."""
    if schema is None:
        return False, []
    try:
        rule = _load(schema)
        return (False, problems(json.loads(content), rule)) if well_formed(rule) else (True, [])
    except (RecursionError, ValueError, OverflowError):
        return True, []


def _load(text: str) -> object:
    def refuse(_: str) -> None:
        raise ValueError("not a JSON number")

    value = json.loads(text, parse_constant=refuse)
    json.dumps(value, ensure_ascii=False).encode()  # half a surrogate pair is no character: refused, as a ValueError
    return value


def _refs(value: object) -> set[str]:
    if isinstance(value, dict):
        if "$ref" in value and len(value) == 1:
            return {str(value["$ref"])}
        return set().union(*map(_refs, value.values())) if value else set()
    return set().union(*map(_refs, value)) if isinstance(value, list) and value else set()


def parse_message(role: str, text: str) -> list[dict]:
    """A message's parts: its plain text, its calls, its result or its tools."""
    if role == "tool":
        try:
            body = _load(text)
            return [{"part": "result", "ref": str(body["tool_call_id"]), "content": canonical(body.get("content"))}]
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            return [{"part": "malformed", "content": text}]
    out = []
    plain = CALL.sub("", text)
    if role == "system":
        for block in TOOLS.findall(text):
            try:
                out += [{"part": "tool", "name": str(t["name"]), "content": canonical(t.get("parameters", True))} for t in _load(block)]
            except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
                out.append({"part": "malformed", "content": block})
    for k, block in enumerate(CALL.findall(text)):
        try:
            call = _load(block)
            arguments = call.get("arguments", {})
            after = call.get("depends_on") or []
            if not isinstance(after, (str, list)):
                raise TypeError("depends_on is an identifier or a list of them")
            needs = sorted(_refs(arguments) | ({after} if isinstance(after, str) else {str(d) for d in after}))
            out.append({"part": "call", "ref": str(call["id"]), "name": str(call["name"]), "content": canonical(arguments), "needs": needs, "nth": k})
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            out.append({"part": "malformed", "content": block, "nth": k})
    if plain.strip() or not out or role == "system":
        out.insert(0, {"part": "text", "content": plain if out else text})
    return out


_PART = "array<struct<part string, ref string, name string, content string, needs array<string>, nth int>>"


def parts(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each part: ``conv, turn, role, part, ref, name, content, needs, nth``."""
    source = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("user")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )

    def run(batch: pa.RecordBatch) -> dict:
        roles = batch.column(2).to_pylist()
        return {
            "conv": batch.column(0),
            "turn": batch.column(1),
            "role": roles,
            "parts": [[{"ref": None, "name": None, "needs": [], "nth": 0} | p for p in parse_message(r, t)] for r, t in zip(roles, batch.column(3).to_pylist(), strict=True)],
        }

    kinds = {k: source.schema[k].dataType.simpleString() for k in ("conv", "turn")}
    found = arrow_map(source, run, f"conv {kinds['conv']}, turn {kinds['turn']}, role string, parts {_PART}")
    return found.select("conv", "turn", "role", F.explode("parts").alias("p")).select("conv", "turn", "role", "p.*")


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", schemas: DataFrame | None = None) -> DataFrame:
    """A row for each part of each message but tools: ``conv_id, turn, role, part, call_id, status,
    problems, order_turn, order_depth, json``. ``schemas`` (name, schema) holds for every
    conversation; tools that a conversation declares come first."""
    found = written(parts(messages, conv_col, turn_col, role_col, text_col), "chat-parts")
    first = Window.partitionBy("conv", "ref").orderBy("turn", "nth", "content")
    calls = found.where("part = 'call'").withColumn("rank", F.row_number().over(first))
    tools = found.where("part = 'tool'").groupBy("conv", "name").agg(F.min_by("content", F.struct(F.col("turn").isNotNull(), "turn", "content")).alias("own_schema"))
    met = calls.join(tools.withColumnsRenamed({"conv": "c", "name": "n"}), F.col("conv").eqNullSafe(F.col("c")) & (F.col("name") == F.col("n")), "left").drop("c", "n")
    if schemas is not None:
        general = schemas.select(F.col("name").alias("n"), F.col("schema").alias("general")).groupBy("n").agg(F.min("general").alias("general"))
        met = met.join(general, F.col("name") == F.col("n"), "left").withColumn("schema", F.coalesce("own_schema", "general"))
    else:
        met = met.withColumn("schema", F.col("own_schema"))
    kinds = {k: found.schema[k].dataType.simpleString() for k in ("conv", "turn")}

    def validate(batch: pa.RecordBatch) -> dict:
        said = [judged(*x) for x in zip(batch.column("content").to_pylist(), batch.column("schema").to_pylist(), strict=True)]
        return {k: batch.column(k) for k in columns} | {"bad": [b for b, _ in said], "problems": [p for _, p in said]}

    columns = ["conv", "turn", "role", "ref", "name", "content", "needs", "nth", "rank", "schema"]
    schema = f"conv {kinds['conv']}, turn {kinds['turn']}, role string, ref string, name string, content string, needs array<string>, nth int, rank int, schema string, bad boolean, problems array<string>"
    checked = written(arrow_map(met.select(*columns), validate, schema), "chat-calls")
    firsts = checked.where("rank = 1").select("conv", "ref", "turn", "needs")
    placed = _order(firsts)
    returned = found.where("part = 'result'").select(F.col("conv").alias("rc"), F.col("ref").alias("rr")).distinct()
    placed = written(placed.join(returned, F.col("conv").eqNullSafe(F.col("rc")) & (F.col("ref") == F.col("rr")), "left").select("conv", "ref", "order_turn", "order_depth", "cyclic", F.col("rc").isNotNull().alias("answered") | F.col("rr").isNotNull()), "chat-order")
    placed = placed.toDF("oc", "oref", "order_turn", "order_depth", "cyclic", "answered")
    on = F.col("conv").eqNullSafe(F.col("oc")) & (F.col("ref") == F.col("oref"))
    call_rows = checked.join(placed, on, "left").select(
        "conv", "turn", "role", F.lit("call").alias("part"), "ref", "problems",
        F.when(F.col("rank") > 1, "duplicate").when(F.col("cyclic"), "cycle").when(F.col("schema").isNull(), "unknown_tool").when(F.col("bad"), "bad_schema").when(F.size("problems") > 0, "invalid").when(~F.col("answered"), "pending").otherwise("linked").alias("status"),
        F.when(F.col("rank") > 1, F.col("turn")).otherwise(F.greatest("order_turn", "turn")).alias("order_turn"),
        F.when(F.col("rank") > 1, F.lit(0)).otherwise(F.col("order_depth")).alias("order_depth"),
        "name", "content",
    )
    result_rows = found.where("part = 'result'").join(placed, on, "left").select(
        "conv", "turn", "role", "part", "ref", F.array().cast("array<string>").alias("problems"),
        F.when(F.col("oref").isNull(), "orphan").when(F.col("cyclic"), "cycle").otherwise("linked").alias("status"),
        F.greatest("turn", "order_turn").alias("order_turn"), F.coalesce(F.col("order_depth") + 1, F.lit(0)).alias("order_depth"), F.lit(None).cast("string").alias("name"), "content",
    )
    other = found.where("part IN ('text', 'malformed')").select(
        "conv", "turn", "role", "part", "ref", F.array().cast("array<string>").alias("problems"), F.when(F.col("part") == "text", "text").otherwise("malformed").alias("status"),
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_depth"), "name", "content",
    )
    return _serialised(call_rows.unionByName(result_rows).unionByName(other), kinds).withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def _order(calls: DataFrame) -> DataFrame:
    """``order_turn``, ``order_depth`` and ``cyclic`` of each call.

    A round places the calls whose needs all have places; only calls placed in the last round
    and those still open are read. There are as many rounds as the longest chain has calls;
    what stays open lies on or behind a cycle. Needs of unknown calls don't bind.
    """
    nodes = written(calls.select("conv", "ref", "turn"), "chat-nodes")
    needs = calls.select(F.col("conv").alias("nc"), F.col("ref").alias("who"), F.explode("needs").alias("need")).distinct()
    known = nodes.select(F.col("conv").alias("kc"), F.col("ref").alias("kr"))
    needs = written(needs.join(known, F.col("nc").eqNullSafe(F.col("kc")) & (F.col("need") == F.col("kr"))).select("nc", "who", "need"), "chat-needs")
    wanted = needs.groupBy("nc", "who").agg(F.count("*").alias("left"))
    start = nodes.join(wanted, F.col("conv").eqNullSafe(F.col("nc")) & (F.col("ref") == F.col("who")), "left")
    start = written(start.select("conv", "ref", "turn", F.coalesce("left", F.lit(0)).alias("left"), F.col("turn").alias("order_turn"), F.lit(0).alias("order_depth")), "chat-state")
    fresh, open_ = start.where("left = 0"), start.where("left > 0")
    placed = fresh
    while not open_.isEmpty() and not fresh.isEmpty():
        last = fresh.select(F.col("conv").alias("bc"), F.col("ref").alias("br"), F.col("order_turn").alias("b_turn"), F.col("order_depth").alias("b_depth"))
        met = needs.join(last, F.col("nc").eqNullSafe(F.col("bc")) & (F.col("need") == F.col("br"))).groupBy("nc", "who")
        reach = met.agg(F.count("*").alias("got"), F.max("b_turn").alias("r_turn"), (F.max("b_depth") + 1).alias("r_depth"))
        after = open_.join(reach, F.col("conv").eqNullSafe(F.col("nc")) & (F.col("ref") == F.col("who")), "left").select(
            "conv", "ref", "turn", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left"), F.greatest("order_turn", "r_turn").alias("order_turn"), F.greatest("order_depth", "r_depth").alias("order_depth")
        )
        after = written(after, "chat-state")
        fresh, open_ = after.where("left = 0"), after.where("left > 0")
        placed = placed.unionByName(fresh)
    cyclic = open_.select("conv", "ref", F.col("turn").alias("order_turn"), F.lit(0).alias("order_depth"), F.lit(True).alias("cyclic"))
    return placed.select("conv", "ref", "order_turn", "order_depth", F.lit(False).alias("cyclic")).unionByName(cyclic)


def _serialised(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The canonical JSON of each part's message."""

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for role, part, ref, name, content in zip(*(batch.column(k).to_pylist() for k in ("role", "part", "ref", "name", "content")), strict=True):
            if part == "call":
                body = {"role": role, "tool_calls": [{"id": ref, "type": "function", "function": {"name": name, "arguments": json.loads(content)}}]}
            elif part == "result":
                body = {"role": role, "tool_call_id": ref, "content": json.loads(content)}
            else:
                body = {"role": role, "content": content}
            out.append(canonical(body))
        return {k: batch.column(k) for k in ("conv", "turn", "role", "part", "ref", "status", "problems", "order_turn", "order_depth")} | {"json": out}

    schema = f"conv {kinds['conv']}, turn {kinds['turn']}, role string, part string, ref string, status string, problems array<string>, order_turn {kinds['turn']}, order_depth int, json string"
    return arrow_map(rows, run, schema).withColumnRenamed("ref", "call_id")
