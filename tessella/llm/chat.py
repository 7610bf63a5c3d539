"""Chat formatting: tool calls linked to results, arguments checked, canonical JSON.

A turn's text may be a JSON object with tool content:
  {"tools": [{"name": ..., "parameters": {JSON schema}}]}             declares tools (any role)
  {"tool_calls": [{"id": ..., "name": ..., "arguments": {...}}]}      calls tools (any role)
  {"tool_call_id": ..., "content": ...}                               answers a call (role tool); may call tools itself
Any other text is plain content. An argument object may also be given as a string of JSON.

Plain turns never leave the JVM. Only texts that begin like an object are parsed, once, into a table that all joins read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches

#: What parsing and writing JSON may raise on texts from outside: such a text is plain content.
_BROKEN = (ValueError, ArithmeticError, RecursionError)


def loads(text: str):
    """JSON as RFC 8259 says; numbers that no double holds stay exact decimals. Of repeated keys the last counts."""
    return json.loads(text, parse_constant=_no_constant, parse_float=_number)


def _no_constant(name: str):
    raise ValueError(f"{name} isn't JSON")


def _number(literal: str):
    near = float(literal)
    if math.isinf(near) or near == 0 and any(c in "123456789" for c in literal.lower().partition("e")[0]):
        return Decimal(literal)
    return near


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; characters beyond ASCII stay as they are, but half a surrogate pair is escaped."""
    try:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except TypeError:  # holds a decimal
        text = _written(value)
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


_HALF = re.compile("[\ud800-\udfff]")


def _written(value) -> str:
    if isinstance(value, Decimal):
        return str(value).replace("E+", "e").replace("E", "e")
    if isinstance(value, list):
        return f"[{','.join(map(_written, value))}]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(v)}" for k, v in sorted(value.items())) + "}"
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


def plain_message(role: str | None, text: str | None) -> str:
    return canonical({"role": role, "content": text})


def parsed(role: str | None, text: str | None) -> tuple[str, list[tuple[str, str, str]], str | None, list[tuple[str, str]]]:
    """(message JSON, calls (id, name, arguments), call id answered, tools (name, schema)) of a turn; ids and names as JSON."""
    if text and text.lstrip(" \t\r\n")[:1] == "{":
        try:
            message, *rest = _tooled(role, loads(text))
            return message or plain_message(role, text), *rest
        except _BROKEN:
            pass
    return plain_message(role, text), [], None, []


def _tooled(role: str | None, value: dict):
    calls, answer, tools = [], None, []
    if role == "tool" and isinstance(value.get("tool_call_id"), str):
        answer = canonical(value["tool_call_id"])
    listed = value.get("tool_calls")
    if isinstance(listed, list) and (role != "tool" or answer is not None):
        calls = [{"id": c["id"], "name": c["name"], "arguments": _arguments(c.get("arguments"))} for c in listed if isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str)]
    else:
        listed = None
    if isinstance(value.get("tools"), list):
        tools = [(canonical(t["name"]), canonical(t.get("parameters") or {})) for t in value["tools"] if isinstance(t, dict) and isinstance(t.get("name"), str)]
    if answer is None and not isinstance(listed, list):
        return None, [], None, tools  # plain content, whatever it declares
    message = {"role": role, "content": value.get("content")}
    if answer is not None:
        message["tool_call_id"] = value["tool_call_id"]
    if isinstance(listed, list) and (calls or answer is None):
        message["tool_calls"] = calls
    return canonical(message), [(canonical(c["id"]), canonical(c["name"]), canonical(c["arguments"])) for c in calls], answer, tools


def _arguments(value):
    if isinstance(value, str):
        try:
            return loads(value)
        except _BROKEN:
            return value
    return {} if value is None else value


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


#: Keywords whose meaning depends on how a schema was reached or on its vocabulary; none can be checked here.
_UNKNOWN = ("$dynamicRef", "$recursiveRef")


def fits(value, schema) -> bool:
    """Whether a value fits a JSON schema: every assertion and combining keyword of drafts 4 to 2020-12, with references
    inside the schema. format and what else only annotates admits everything.

    ValueError where that can't be told: a reference that leads out of the schema or nowhere, a dynamic one, or a
    pattern that isn't one of Python's. Where the rest refuses the value already, False.
    """
    return _Schema(schema).judge(value, schema)[0]


def _same(value) -> str:
    """Text that is equal for equal JSON values: 1 and 1.0 are one number."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if isinstance(value, Decimal):
        value = value.normalize()
    if isinstance(value, list):
        return f"[{','.join(map(_same, value))}]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{_same(v)}" for k, v in sorted(value.items())) + "}"
    return canonical(value)


def _matches(pattern: str, text: str) -> bool:
    """Search as ECMA-262 says: classes are ASCII, $ is the end alone, groups are named without P. The engine takes time in proportion to the text whatever the pattern, so it knows neither
    looking ahead or behind nor references to groups."""
    spelt = lambda x: re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", x)
    own = re.sub(r"\\u[0-9a-fA-F]{4}|\\.|\[(?:\\.|[^\]\\])*\]|\$|\(\?<(?![=!])", lambda m: {"$": r"\z", "(?<": "(?P<"}.get(m[0], spelt(m[0])), pattern, flags=re.S)
    try:
        return pc.match_substring_regex(pa.scalar(text), own).as_py()
    except pa.ArrowInvalid as e:
        raise ValueError(f"pattern {pattern!r}") from e


class _Schema:
    """A schema's root, for references, and the judgement of values by its parts."""

    def __init__(self, root):
        self.root, self.known = root, {}

    def find(self, reference: str):
        if isinstance(self.root, dict) and (own := self.root.get("$id", self.root.get("id"))) and isinstance(own, str) and reference.startswith(own.rstrip("#")):
            reference = "#" + reference[len(own.rstrip("#")) :].lstrip("#")
        if not reference.startswith("#"):
            raise ValueError(f"reference {reference}")
        path = unquote(reference[1:])
        if path and path[0] != "/":
            return self.anchored(path)
        at = self.root
        for step in path.split("/")[1:]:
            step = step.replace("~1", "/").replace("~0", "~")
            if isinstance(at, list) and step.isdecimal() and int(step) < len(at):
                at = at[int(step)]
            elif isinstance(at, dict) and step in at:
                at = at[step]
            else:
                raise ValueError(f"reference {reference}")
        return at

    def anchored(self, name: str):
        rest = [self.root]
        while rest:
            at = rest.pop()
            if isinstance(at, dict):
                if name in (at.get("$anchor"), at.get("$dynamicAnchor")) or f"#{name}" in (at.get("$id"), at.get("id")):
                    return at
                rest += at.values()
            elif isinstance(at, list):
                rest += at
        raise ValueError(f"reference #{name}")

    def judge(self, value, schema) -> tuple[bool, set]:
        """(whether value fits, the names or places in it that the schema judged), each value by each part of the schema once."""
        place = id(value), id(schema)  # both live as long as the judgement
        if place not in self.known:
            self.known[place] = ValueError("a reference that comes back to itself")
            try:
                self.known[place] = self._judge(value, schema)
            except ValueError as e:
                self.known[place] = e
                raise
        if isinstance(self.known[place], ValueError):
            raise self.known[place]
        good, seen = self.known[place]
        return good, set(seen)

    def _judge(self, value, schema) -> tuple[bool, set]:
        if not isinstance(schema, dict):
            return schema is not False, set()
        if not self._plain(value, schema):
            return False, set()
        seen: set = set()
        for good, more in self._combined(value, schema):
            if not good:
                return False, set()
            seen |= more
        good = True
        if isinstance(value, dict):
            good = self._object(value, schema, seen)
        elif isinstance(value, list):
            good = self._array(value, schema, seen)
        if good and any(k in schema for k in _UNKNOWN):
            raise ValueError("a dynamic reference")
        return good, seen if good else set()

    def _plain(self, value, schema: dict) -> bool:
        kinds = schema.get("type")
        if kinds is not None and not any(self.judge(value, k)[0] if isinstance(k, dict) else _is(value, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
            return False
        if "enum" in schema and _same(value) not in map(_same, schema["enum"]):
            return False
        if "const" in schema and _same(value) != _same(schema["const"]):
            return False
        if isinstance(value, str):
            if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
                return False
            return "pattern" not in schema or _matches(schema["pattern"], value)
        if _is(value, "number"):
            low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
            if low is True or low is False:  # draft 4: whether minimum itself is out
                low = schema.get("minimum") if low else None
            if high is True or high is False:
                high = schema.get("maximum") if high else None
            if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
                return False
            if low is not None and value <= low or high is not None and value >= high:
                return False
            if "multipleOf" in schema and (isinstance(value, Decimal) or isinstance(schema["multipleOf"], Decimal)):
                raise ValueError("a multiple beyond doubles")
            return "multipleOf" not in schema or Fraction(str(value)) % Fraction(str(schema["multipleOf"])) == 0
        if isinstance(value, list):
            if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
                return False
            return schema.get("uniqueItems") is not True or len(set(map(_same, value))) == len(value)
        if isinstance(value, dict):
            if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
                return False
            required = schema.get("required", ())
            if isinstance(required, (list, tuple)) and any(r not in value for r in required):
                return False
            needs = {**schema.get("dependentRequired", {}), **{k: v for k, v in schema.get("dependencies", {}).items() if isinstance(v, list)}}
            return all(r in value for k, names in needs.items() if k in value for r in names)
        return True

    def _combined(self, value, schema: dict):
        """Judgements of value by the schemas that apply to it in place; those that fail without harm count as judging nothing."""
        if "$ref" in schema:
            yield self.judge(value, self.find(schema["$ref"]))
        for s in schema.get("allOf", ()):
            yield self.judge(value, s)
        for name in ("anyOf", "oneOf"):
            if name in schema:
                fitting, unknown = [], None
                for s in schema[name]:
                    try:
                        fitting += [x for x in (self.judge(value, s),) if x[0]]
                    except ValueError as e:
                        unknown = e
                if unknown and (name == "oneOf" and len(fitting) < 2 or not fitting):
                    raise unknown
                yield bool(fitting) if name == "anyOf" else len(fitting) == 1, set().union(*(x[1] for x in fitting))
        if "not" in schema:
            yield not self.judge(value, schema["not"])[0], set()
        if "if" in schema:
            good, seen = self.judge(value, schema["if"])
            yield True, seen
            if (then := "then" if good else "else") in schema:
                yield self.judge(value, schema[then])
        if isinstance(value, dict):
            for k, s in {**schema.get("dependencies", {}), **schema.get("dependentSchemas", {})}.items():
                if k in value and not isinstance(s, list):
                    yield self.judge(value, s)

    def _object(self, value: dict, schema: dict, seen: set) -> bool:
        known, patterns, own = schema.get("properties", {}), schema.get("patternProperties", {}), set()
        for k, v in value.items():
            by = [known[k]] if k in known else []
            by += [s for p, s in patterns.items() if _matches(p, k)]
            if not by and "additionalProperties" in schema:
                by = [schema["additionalProperties"]]
            if by:
                own.add(k)
            if not all(self.judge(v, s)[0] for s in by) or "propertyNames" in schema and not self.judge(k, schema["propertyNames"])[0]:
                return False
        seen |= own
        if "unevaluatedProperties" in schema:
            if not all(self.judge(v, schema["unevaluatedProperties"])[0] for k, v in value.items() if k not in seen):
                return False
            seen |= value.keys()
        return True

    def _array(self, value: list, schema: dict, seen: set) -> bool:
        items, first, rest = schema.get("items"), schema.get("prefixItems", []), schema.get("items")
        if isinstance(items, list):  # before 2020-12
            first, rest = items, schema.get("additionalItems")
        for i, v in enumerate(value):
            s = first[i] if i < len(first) else rest
            if s is not None:
                seen.add(i)
                if not self.judge(v, s)[0]:
                    return False
        if "contains" in schema:
            held = {i for i, v in enumerate(value) if self.judge(v, schema["contains"])[0]}
            if not schema.get("minContains", 1) <= len(held) <= schema.get("maxContains", len(held)):
                return False
            seen |= held
        if "unevaluatedItems" in schema:
            if not all(self.judge(v, schema["unevaluatedItems"])[0] for i, v in enumerate(value) if i not in seen):
                return False
            seen |= set(range(len(value)))
        return True


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        good = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
        return good and (kind == "number" or isinstance(value, int) or (value.as_tuple().exponent >= 0 if isinstance(value, Decimal) else value.is_integer()))
    return isinstance(value, _TYPES.get(kind, object)) and not (kind != "boolean" and isinstance(value, bool))


_PARSED = "row string, conv_id {id}, turn {turn}, role string, message string, calls array<struct<id:string,name:string,arguments:string>>, answers string, tools array<struct<name:string,parameters:string>>"


def _parse():
    call = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string())]))
    tool = pa.list_(pa.struct([("name", pa.string()), ("parameters", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parsed(r, t) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            columns = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([[dict(zip(("id", "name", "arguments"), c, strict=True)) for c in f[1]] for f in found], call),
                pa.array([f[2] for f in found], pa.string()),
                pa.array([[dict(zip(("name", "parameters"), t, strict=True)) for t in f[3]] for f in found], tool),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *columns], ["row", "conv_id", "turn", "role", "message", "calls", "answers", "tools"])

    return run


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether arguments fit the declared schema; without one, whether they are an object. What can't be told isn't valid."""
    for batch in batches:
        at = batch.schema.names.index
        good = []
        for arguments, schema in zip(batch.column(at("arguments")).to_pylist(), batch.column(at("parameters")).to_pylist(), strict=True):
            try:
                value = loads(arguments)
                good.append(isinstance(value, dict) and (schema is None or fits(value, loads(schema))))
            except (ValueError, TypeError, AttributeError, ArithmeticError, RecursionError):
                good.append(False)
        yield pa.RecordBatch.from_arrays([batch.column(at("row")), batch.column(at("conv_id")), batch.column(at("call")), batch.column(at("turn")), pa.array(good, pa.bool_())], ["row", "conv_id", "call", "turn", "valid"])


def _first_known(a: Column, b: Column) -> Column:
    """Whether b is as large as a or larger; a null is smaller than anything."""
    return F.when(b.isNull(), a.isNull()).when(a.isNull(), True).otherwise(b >= a)


def _order(turns: DataFrame, links: DataFrame, ws: Workspace) -> DataFrame:
    """(row, order_turn, order_step) of the linked results.

    A result hangs on the turn that called it, which may be a result itself. Its place is the latest turn on its way up,
    and how far up the farthest turn of that number stands. Ways are doubled every round, so rounds are few;
    who answers in a circle has no end of a way after that, and keeps its own place.
    """
    up = links.groupBy(F.col("result_row").alias("row")).agg(F.max("call_row").alias("up"))
    ends = links.select(F.col("call_row").alias("row")).distinct().join(up, "row", "left_anti").withColumn("up", F.lit(None).cast("string"))
    own = turns.select("row", "turn")
    way = up.unionByName(ends).join(own, "row").select("row", "up", F.col("turn").alias("top"), F.lit(0).alias("far"), F.lit(1).alias("steps"), "turn")
    way = ws.keep(way, "way-0")
    rounds = max(1, math.ceil(math.log2(max(2, way.count()))) + 1)
    for k in range(rounds):
        if way.where("up is not null").isEmpty():
            break
        rest = way.select(F.col("row").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("far").alias("_far"), F.col("steps").alias("_steps"))
        both = way.join(rest, "up", "left")
        farther = F.col("_steps").isNotNull() & _first_known(F.col("top"), F.col("_top"))
        way = both.select(
            "row", F.col("_up").alias("up"), F.when(farther, F.col("_top")).otherwise(F.col("top")).alias("top"),
            F.when(farther, F.col("steps") + F.col("_far")).otherwise(F.col("far")).alias("far"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), "turn",
        )
        way = ws.keep(way, f"way-{k + 1}")
    round_about = F.col("up").isNotNull()
    return way.select("row", F.when(round_about, F.col("turn")).otherwise(F.col("top")).alias("order_turn"), F.when(round_about, 0).otherwise(F.col("far")).alias("order_step"))


def link_tool_calls(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn: conv_id, turn, role, order_turn, order_step, n_calls, n_linked, n_invalid,
    answers_call, message (canonical JSON).

    Within a conversation, (order_turn, order_step, turn) orders the turns topologically: a result that stands
    before its call, or in the same turn, moves behind it (order_step counts from the turn it moved to, over calls that are results themselves),
    everything else keeps its place; results that answer each other in a circle stay. Calls and results
    meet by identifier. Of several calls or results with one identifier, those of the first turn (in one turn, the first
    listed) are linked; the others aren't. n_linked counts a turn's calls that have a result; n_invalid
    those whose arguments aren't known to fit their tool's schema (the first declared under its name), or are no object;
    a schema that is broken or leads outside itself vouches for nothing.
    answers_call says whether a turn is the linked result of a call; null for turns that answer nothing.
    Null roles and texts stay null in the JSON, a null conversation is one of its own and links nothing, and
    a null turn number comes first. Rows of one (conv_id, turn) are separate turns; equal rows are treated alike.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    ws = Workspace(spark, "chat")
    kind = lambda c: turns.schema[c].dataType.simpleString()
    chosen = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    # an object, or a character that JSON writers of the JVM escape in another way
    apart = F.coalesce(F.col("text").rlike(r"^[ \t\r\n]*\{"), F.lit(False)) | F.coalesce(F.concat_ws("", "role", "text").rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), F.lit(False))
    row = F.sha2(F.to_json(F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x")), {"ignoreNullFields": "false"}), 256)
    objects = chosen.where(apart).select(row.alias("row"), "conv_id", "turn", "role", "text")
    objects = ws.keep(objects.mapInArrow(_parse(), _PARSED.format(id=kind(conv_col), turn=kind(turn_col))), "objects")

    message = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")), {"ignoreNullFields": "false"})
    zero = F.lit(0).cast("long")
    flat = chosen.where(~apart).select("conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), zero.alias("n_calls"), zero.alias("n_linked"), zero.alias("n_invalid"), F.lit(None).cast("boolean").alias("answers_call"), message.alias("message"))
    if objects.isEmpty():
        return flat

    # turns with tool content, once each; plain turns take no part in any join
    tooled = objects.where("size(calls) > 0 or answers is not null or size(tools) > 0").dropDuplicates(["row"])
    tooled = tooled.where("conv_id is not null")
    calls = tooled.select("row", "conv_id", "turn", F.posexplode("calls").alias("at", "c"))
    calls = calls.select("row", "conv_id", "turn", "at", F.col("c.id").alias("call"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))
    first_call = calls.groupBy("conv_id", "call").agg(F.min(F.struct("turn", "row", "at")).alias("c"))
    results = tooled.where("answers is not null").groupBy("conv_id", F.col("answers").alias("call")).agg(F.min(F.struct("turn", "row")).alias("r"))
    links = ws.keep(first_call.join(results, ["conv_id", "call"]).select(F.col("c.row").alias("call_row"), F.col("r.row").alias("result_row")), "links")

    tools = tooled.select("conv_id", "turn", "row", F.posexplode("tools").alias("at", "t"))
    tools = tools.groupBy("conv_id", F.col("t.name").alias("name")).agg(F.min(F.struct("turn", "row", "at", F.col("t.parameters").alias("parameters"))).alias("t"))
    judged = calls.join(tools.select("conv_id", "name", F.col("t.parameters").alias("parameters")), ["conv_id", "name"], "left")
    judged = judged.mapInArrow(_check, f"row string, conv_id {kind(conv_col)}, call string, turn {kind(turn_col)}, valid boolean")
    invalid = judged.groupBy("row").agg(F.count_if(~F.col("valid")).alias("n_invalid"))

    linked = links.groupBy(F.col("call_row").alias("row")).agg(F.count("*").alias("n_linked"))
    order = _order(tooled, links, ws)
    moved = links.select(F.col("result_row").alias("row"), F.lit(True).alias("is_linked")).distinct().join(order, "row")
    tool = objects.join(linked, "row", "left").join(moved, "row", "left").join(invalid, "row", "left")
    out = tool.select(
        "conv_id", "turn", "role", F.when(F.col("is_linked"), F.col("order_turn")).otherwise(F.col("turn")).alias("order_turn"), F.coalesce("order_step", F.lit(0)).alias("order_step"),
        F.size("calls").cast("long").alias("n_calls"), F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("n_invalid", zero).alias("n_invalid"),
        F.when(F.col("answers").isNotNull(), F.coalesce("is_linked", F.lit(False))).alias("answers_call"), "message",
    )
    return flat.unionByName(out)
