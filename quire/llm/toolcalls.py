"""Linking tool calls with their results.

Calls and results are joined by conversation and call id; a conversation isn't brought together in one task
for it. Results of one id are reduced to the first before the join. Calls are ordered topologically by
levels: a call's level is one more than the highest level among the calls it depends on; calls on a cycle, or behind
one, have none. Chains, which are most of what conversations have, are followed by pointer doubling, so that a chain of n
calls takes log n distributed rounds; only calls with several dependencies, and these without chains between them, take a
round a level. Arguments are parsed, checked against the schema of the call's name and serialised as canonical JSON (sorted
keys, no blanks, UTF-8 as it is, lone surrogates escaped).

Cases: a null id or conversation links nothing and is kept as unlinked; a repeated call id counts once, the
least of its rows by turn, name and arguments is the call and all others, equal ones too, are marked repeated; a result without a call has no row of its own
but is counted by `orphans`; several results: the first by turn, with their number; arguments that are no
JSON object, hold numbers that JSON lacks (NaN, infinities, beyond a double) or are nested deeper than can be followed are invalid
and stay as a JSON string; a name without a schema is invalid; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import removed, written

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks; whole floats as integers."""

    def plain(x: object) -> object:
        if isinstance(x, float):
            return int(x) if math.isfinite(x) and x == int(x) and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    out = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", out)  # no UTF-8 has these


def parsed(raw: str | None) -> object:
    """The value of a JSON text; ValueError for anything that JSON can't hold."""

    def number(text: str) -> float:
        if not math.isfinite(x := float(text)):
            raise ValueError("number out of range")
        return x

    def constant(name: str) -> None:
        raise ValueError(f"{name} is no JSON")

    return json.loads(raw if raw is not None else "null", parse_float=number, parse_constant=constant)


#: Keywords that say nothing about a value.
_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
_PLAIN = {
    "type", "enum", "const", "required", "additionalProperties", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern",
    "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties", "$ref",
}
_ONE, _LIST, _NAMED = {"items", "not", "propertyNames", "additionalProperties"}, {"anyOf", "allOf", "oneOf"}, {"properties", "patternProperties", "$defs", "definitions"}


def accepted(schema: object, root: object = None, path: str = "#") -> None:
    """ValueError for a schema that `violations` can't follow: an unknown keyword or type, a pattern that isn't one, a reference that leads nowhere. So no keyword is passed over in silence."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{path}: no schema")
    if unknown := set(schema) - _NOTES - _PLAIN - _ONE - _LIST - _NAMED:
        raise ValueError(f"{path}: unknown keywords {sorted(unknown)}")
    kinds = schema.get("type", [])
    for kind in kinds if isinstance(kinds, list) else [kinds]:
        if kind not in _TYPES and kind not in ("number", "integer"):
            raise ValueError(f"{path}: unknown type {kind!r}")
    for pattern in [*([schema["pattern"]] if "pattern" in schema else []), *schema.get("patternProperties", {})]:
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"{path}: {e}") from None
    if "$ref" in schema:
        _target(schema["$ref"], root)
    for k in _ONE & set(schema):
        accepted(schema[k], root, f"{path}/{k}")
    for k in _LIST & set(schema):
        for i, part in enumerate(schema[k]):
            accepted(part, root, f"{path}/{k}/{i}")
    for k in _NAMED & set(schema):
        for name, part in schema[k].items():
            accepted(part, root, f"{path}/{k}/{name}")


def _target(ref: str, root: object) -> object:
    """What a reference within the schema (#/...) leads to."""
    at = root
    if not ref.startswith("#"):
        raise ValueError(f"{ref}: only references within the schema are followed")
    for part in ref[1:].split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            at = at[int(part)] if isinstance(at, list) else at[part]
        except (KeyError, IndexError, TypeError, ValueError):
            raise ValueError(f"{ref} leads nowhere") from None
    return at


def _same(value: object) -> object:
    """A key that JSON values share if they are equal: 1 and 1.0, but not 1 and true."""
    if isinstance(value, bool) or value is None:
        return ("", str(value))
    if isinstance(value, dict):
        return ("{", tuple(sorted((k, _same(v)) for k, v in value.items())))
    if isinstance(value, list):
        return ("[", tuple(_same(v) for v in value))
    return ("0" if isinstance(value, (int, float)) else '"', value)


def _fits(value: object, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number":
        return number
    if kind == "integer":
        return number and (isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


def violations(value: object, schema: object, path: str = "$", root: object = None) -> list[str]:
    """What breaks a schema that is `accepted`."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    out, kinds = [], schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds is not None and not any(_fits(value, k) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    if "$ref" in schema:
        out += violations(value, _target(schema["$ref"], root), path, root)
    if "enum" in schema and _same(value) not in [_same(v) for v in schema["enum"]]:
        out.append(f"{path}: not in enum")
    if "const" in schema and _same(value) != _same(schema["const"]):
        out.append(f"{path}: not the constant")
    if "anyOf" in schema and all(violations(value, s, path, root) for s in schema["anyOf"]):
        out.append(f"{path}: none of anyOf")
    if "oneOf" in schema and sum(not violations(value, s, path, root) for s in schema["oneOf"]) != 1:
        out.append(f"{path}: not one of oneOf")
    for s in schema.get("allOf", []):
        out += violations(value, s, path, root)
    if "not" in schema and not violations(value, schema["not"], path, root):
        out.append(f"{path}: what it must not be")
    if _fits(value, "number"):
        out += [f"{path}: below minimum"] * (value < schema.get("minimum", -math.inf) or value <= schema.get("exclusiveMinimum", -math.inf))
        out += [f"{path}: above maximum"] * (value > schema.get("maximum", math.inf) or value >= schema.get("exclusiveMaximum", math.inf))
        if "multipleOf" in schema and Fraction(value) % Fraction(str(schema["multipleOf"])) and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
            out.append(f"{path}: no multiple")
    if isinstance(value, str):
        out += [f"{path}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{path}: too long"] * (len(value) > schema.get("maxLength", math.inf))
        out += [f"{path}: not of the pattern"] * ("pattern" in schema and not re.search(schema["pattern"], value))
    if isinstance(value, dict):
        known, patterns, more = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [f"{path}: too few properties"] * (len(value) < schema.get("minProperties", 0)) + [f"{path}: too many properties"] * (len(value) > schema.get("maxProperties", math.inf))
        for k in sorted(value):
            fitting = ([known[k]] if k in known else []) + [s for p, s in patterns.items() if re.search(p, k)]
            if not fitting and more is False:
                out.append(f"{path}.{k}: unknown")
            for s in fitting or ([more] if more is not False else []):
                out += violations(value[k], s, f"{path}.{k}", root)
            if "propertyNames" in schema:
                out += violations(k, schema["propertyNames"], f"{path}.{k}", root)
    if isinstance(value, list):
        out += [f"{path}: too few items"] * (len(value) < schema.get("minItems", 0)) + [f"{path}: too many items"] * (len(value) > schema.get("maxItems", math.inf))
        out += [f"{path}: items repeat"] * (bool(schema.get("uniqueItems")) and len({_same(v) for v in value}) < len(value))
        for i, v in enumerate(value):
            out += violations(v, schema.get("items", True), f"{path}[{i}]", root)
    return out


def checked(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls (conv_id, call_id, turn, name, arguments) with arguments canonical, valid, problems. A schema that isn't `accepted` is an error before any row is read."""
    for schema in schemas.values():
        accepted(schema)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, valid, problems = [], [], []
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist(), strict=True):
                try:
                    value = parsed(raw)
                    found = violations(value, {"type": "object"}) or (violations(value, schemas[name]) if name in schemas else [f"$: no schema for {name}"])
                    text = canonical(value)
                except ValueError:
                    text, found = canonical(raw), ["$: no JSON"]
                except RecursionError:
                    text, found = canonical(raw), ["$: nested too deeply"]
                texts.append(text)
                valid.append(not found)
                problems.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "call_id", "turn", "name")), pa.array(texts, pa.string()), pa.array(valid), pa.array(problems, pa.list_(pa.string()))], ["conv_id", "call_id", "turn", "name", "arguments", "valid", "problems"])

    picked = calls.select(F.col("conv_id").cast("long"), F.col("call_id").cast("string"), F.col("turn").cast("long"), F.col("name").cast("string"), F.col("arguments").cast("string"))
    return picked.mapInArrow(check, "conv_id long, call_id string, turn long, name string, arguments string, valid boolean, problems array<string>")


def levels(calls: DataFrame, depends: DataFrame) -> DataFrame:
    """conv_id, call_id, level. depends: (conv_id, call_id, on_id); what isn't a call is no dependency."""
    ids = written(calls.select("conv_id", "call_id").dropna().distinct(), "calls")
    edges = depends.select("conv_id", "call_id", "on_id").dropna().distinct()
    edges = written(edges.join(ids, ["conv_id", "call_id"], "left_semi").join(ids.withColumnRenamed("call_id", "on_id"), ["conv_id", "on_id"], "left_semi"), "edges")
    # a call with one dependency points at it, and then at where that points, until it points at a head: a call with none or several
    count = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("on_id").alias("to"))
    single = written(count.where("n = 1").select("conv_id", "call_id", "to", F.lit(1).cast("long").alias("steps")), "pointers")
    names = single.select("conv_id", "call_id")
    pointers, rounds = single, max(1, single.count()).bit_length()
    for _ in range(rounds):
        on = pointers.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        last, pointers = pointers, written(pointers.join(on, ["conv_id", "to"], "left").select("conv_id", "call_id", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "pointers")
        if pointers.join(names.withColumnRenamed("call_id", "to"), ["conv_id", "to"], "left_semi").isEmpty():
            break
        if last is not single:
            removed(last)
    # whoever still points at a call with one dependency is on a cycle or behind one
    pointers = written(pointers.join(names.withColumnRenamed("call_id", "to"), ["conv_id", "to"], "left_anti"), "chains")
    heads = written(ids.join(names, ["conv_id", "call_id"], "left_anti"), "heads")
    here = heads.select("conv_id", "call_id", F.col("call_id").alias("to"), F.lit(0).cast("long").alias("steps"))
    where = pointers.select("conv_id", "call_id", "to", "steps").unionByName(here)
    # edges between heads, as long as the chains between them; one to a cycle leads nowhere
    own = edges.join(heads, ["conv_id", "call_id"], "left_semi")
    own = own.join(where.select("conv_id", F.col("call_id").alias("on_id"), F.col("to").alias("on_head"), (F.col("steps") + 1).alias("far")), ["conv_id", "on_id"], "left").select("conv_id", "call_id", "on_head", "far")
    own, todo = written(own, "edges"), heads
    ready = written(heads.join(own, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")), "level")
    placed = ready
    while not ready.isEmpty():
        todo = written(todo.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"), "heads")
        left = own.join(todo, ["conv_id", "call_id"], "left_semi")
        reached = left.join(placed.select("conv_id", F.col("call_id").alias("on_head"), "level"), ["conv_id", "on_head"], "left")
        found = reached.groupBy("conv_id", "call_id").agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        ready = written(found.where("open = 0").select("conv_id", "call_id", "level"), "level")
        placed = placed.unionByName(ready)
    chained = where.join(placed.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"], "left").select("conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level"))
    return ids.join(chained, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("level").cast("int").alias("level"))


def linked(calls: DataFrame, results: DataFrame, depends: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row a call: conv_id, call_id, turn, name, level, arguments, valid, problems, repeated, n_results, result (canonical JSON of the first), linked. A conversation's topological order is (level, turn, call_id)."""
    # equal rows are counted, so that one of them can be told from the others without sorting an id's rows
    good = checked(calls, schemas).groupBy("conv_id", "call_id", "turn", "name", "arguments", "valid", "problems").agg(F.count(F.lit(1)).alias("copies"))
    row = F.struct("turn", "name", "arguments")
    first = good.groupBy("conv_id", "call_id").agg(F.min(row).alias("first"))
    found = results.select(F.col("conv_id").cast("long"), F.col("call_id").cast("string"), F.col("turn").cast("long").alias("result_turn"), F.col("content").cast("string").alias("content"))
    found = found.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("result_turn", "content")).alias("r"))
    joined = good.join(first, ["conv_id", "call_id"], "left").join(found, ["conv_id", "call_id"], "left").join(levels(calls, depends), ["conv_id", "call_id"], "left")
    text = F.to_json(F.struct(F.col("r.content").alias("content")))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    again = (F.col("copy") > 1) | ~row.eqNullSafe(F.col("first"))
    return joined.select(
        "conv_id", "call_id", "turn", "name", "level", "arguments", "valid", "problems", (F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & again).alias("repeated"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.when(F.col("r").isNotNull(), text).alias("result"), F.col("r").isNotNull().alias("linked"),
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results that no call asked for."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


#: The calls that `from_turns` makes.
TURN_SCHEMAS = {
    "ask": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, depends) of plain conversations: a user's turn is a call named ask, the assistant's turn right after it is its result, and a call depends on the one two turns before, whose answer it follows."""
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    asked = base.where("role = 'user'")
    calls = asked.select("conv_id", call_id(F.col("turn")).alias("call_id"), "turn", F.lit("ask").alias("name"), F.to_json(F.struct("turn", "text")).alias("arguments"))
    results = base.where("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    depends = asked.select("conv_id", call_id(F.col("turn")).alias("call_id"), call_id(F.col("turn") - 2).alias("on_id"))
    return calls, results, depends


def of_conversations(turns: DataFrame) -> DataFrame:
    calls, results, depends = from_turns(turns)
    out = linked(calls, results, depends, TURN_SCHEMAS)
    return out.select("conv_id", "call_id", "turn", "name", F.col("level").cast("long").alias("level"), "arguments", "valid", F.size("problems").cast("long").alias("n_problems"), "repeated", "n_results", "result", "linked")
