"""Chat formatting: tool calls are linked to results, ordered, validated, and written as canonical JSON.

A message's text may be a JSON object with "tool_calls", a list of calls with "id",
"name" and "arguments" (an object, or a JSON string of one), or, in a message of role
"tool", a result with "tool_call_id" and "content".  Calls and results are joined by
conversation and identifier.  An argument value {"$result": id} makes a call depend on
the result of that call.

Order: each message gets an anchor (the latest turn among itself and all it depends on)
and a depth (how many dependencies moved it there); sorting a conversation by anchor,
depth, turn is a topological order that leaves messages in place where it can.  The links
of a conversation of at most GROUP_LINKS are ordered in one task; a larger conversation is
never gathered: its anchors are found by repeated joins of links until nothing moves.
Both ways give the same.  Messages in a cycle keep depth null and their own turn, and
messages that depend on them follow that turn.

Validation: arguments are checked against the JSON schema of the tool.  KEYWORDS lists
the schema words that are supported; words that only describe are ignored, and a schema
with any other word, or with a value that a word can't have, is refused before anything
runs.  Numbers are compared exactly, as they are written: 0.3 is a multiple of 0.1.

Canonical JSON: keys sorted by code points, no spaces, UTF-8 as it is.  Whole numbers
below 1e21 are written as integers (1, 1.0 and 1e0 are the same), integers of any length
digit by digit, other numbers with the fewest digits that read back the same.

Identifiers: a string is itself, anything else is known by its canonical JSON, so 1, 1.0
and "1" are one identifier, and objects that differ in the order of keys are.

Defined cases: a null text is "", a null role is JSON null; null ids or turns are keys
like others for plain messages but carry no links.  Text that isn't such an object is
plain content; so is text that nests more than MAX_NEST levels, holds a number beyond the
range of doubles, or NaN or Infinity (arguments given as such a JSON string are null).
Lone surrogates become U+FFFD.  Calls with the same id in one conversation: the first
(by turn and place) is linked, later ones are counted as duplicates; so are results.
Tools without a schema are not validated (counted as unknown).  Repeated rows give
repeated rows.  Other columns are ignored, whatever their names.  Texts of any length
are read whole.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool, unspool

#: Links of a conversation up to which one task orders it.
GROUP_LINKS = 100_000
#: Levels of arrays and objects in a text.
MAX_NEST = 200
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: Words of JSON schema that are checked, and words that only describe.
KEYWORDS = {
    "type", "enum", "const", "properties", "required", "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems", "uniqueItems",
    "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "allOf", "anyOf", "oneOf", "not",
}
NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format", "$schema", "$id", "$comment"}

#: Schemas of the query's tools.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}


def _number(value: float) -> str:
    if value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    digits, _, power = repr(abs(value)).partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    sign, point = "-" * (value < 0), len(whole) + int(power or 0)
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len(figures)
    figures = figures.rstrip("0")
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    if 0 < point < len(figures):
        return f"{sign}{figures[:point]}.{figures[point:]}"
    return f"{sign}{figures[0]}{'.' * (len(figures) > 1)}{figures[1:]}e{point - 1:+d}"


def canonical(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    sys.set_int_max_str_digits(0)  # whole numbers of any length
    return json.dumps(value, ensure_ascii=False)


def _whole(text: str) -> str:
    """text with U+FFFD for lone surrogates."""
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[{]|[\]}]', re.S)


def _too_deep(text: str) -> bool:
    if text.count("[") + text.count("{") <= MAX_NEST:
        return False
    depth = 0
    for m in _BRACKETS.finditer(text):
        c = m[0][0]
        depth += 1 if c in "[{" else -1 if c in "]}" else 0
        if depth > MAX_NEST:
            return True
    return False


def _refuse(name: str):
    raise ValueError(name)


def _double(text: str) -> float:
    value = float(text)
    return value if abs(value) != float("inf") else _refuse(text)


def _loads(text: str):
    if _too_deep(text):
        return None
    sys.set_int_max_str_digits(0)
    try:
        return json.loads(text, parse_constant=_refuse, parse_float=_double)
    except ValueError:
        return None


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def _exact(value: float) -> Fraction:
    return Fraction(repr(value)) if isinstance(value, float) else Fraction(value)


def _finite(value) -> bool:
    return _is(value, "number") and abs(value) != float("inf") and value == value


def _texts(value) -> bool:
    return isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value)


#: What the value of a schema word must be.
_FITS = {
    "type": lambda v: isinstance(v, str) or _texts(v) and len(v) > 0,
    "enum": lambda v: isinstance(v, (list, tuple)),
    "properties": lambda v: isinstance(v, Mapping) and _texts(list(v)),
    "required": _texts,
    "uniqueItems": lambda v: isinstance(v, bool),
    "pattern": lambda v: isinstance(v, str),
    **dict.fromkeys(("minProperties", "maxProperties", "minItems", "maxItems", "minLength", "maxLength"), lambda v: _finite(v) and v >= 0 and v == int(v)),
    **dict.fromkeys(("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"), _finite),
    "multipleOf": lambda v: _finite(v) and v > 0,
    **dict.fromkeys(("allOf", "anyOf", "oneOf"), lambda v: isinstance(v, (list, tuple)) and len(v) > 0),
}


def check_schema(schema, depth: int = 0) -> None:
    """Raise ValueError for words, types and values of words that valid() doesn't know."""
    if isinstance(schema, bool):
        return
    if depth > MAX_NEST or not isinstance(schema, Mapping) or not _texts(list(schema)):
        raise ValueError(f"not a schema: {str(schema)[:200]}")
    if unknown := set(schema) - KEYWORDS - NOTES:
        raise ValueError(f"schema words not supported: {sorted(unknown)}")
    for word, fits in _FITS.items():
        if word in schema and not fits(schema[word]):
            raise ValueError(f"schema word {word} can't be {str(schema[word])[:200]}")
    kinds = schema.get("type", [])
    if bad := set([kinds] if isinstance(kinds, str) else kinds) - set(_TYPES) - {"integer", "number"}:
        raise ValueError(f"schema types not known: {sorted(bad)}")
    try:
        re.compile(schema.get("pattern", ""))
        for value in [*schema.get("enum", ()), schema.get("const")]:
            canonical(value)
    except (re.error, TypeError, ValueError, RecursionError, OverflowError) as e:
        raise ValueError(f"schema values not supported: {e}") from e
    inner = [*schema.get("properties", {}).values(), *schema.get("allOf", ()), *schema.get("anyOf", ()), *schema.get("oneOf", ())]
    for s in inner + [schema[k] for k in ("items", "additionalProperties", "not") if k in schema]:
        check_schema(s, depth + 1)


def valid(value, schema) -> bool:
    """Whether value meets the schema; a reference to a result meets any."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return True
    if isinstance(schema, bool):
        return schema
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return False
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return False
    if not all(valid(value, s) for s in schema.get("allOf", ())):
        return False
    if "anyOf" in schema and not any(valid(value, s) for s in schema["anyOf"]):
        return False
    if "oneOf" in schema and sum(valid(value, s) for s in schema["oneOf"]) != 1:
        return False
    if "not" in schema and valid(value, schema["not"]):
        return False
    if isinstance(value, str):
        fits = schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
        return fits and ("pattern" not in schema or re.search(schema["pattern"], value) is not None)
    if _is(value, "number"):
        low, high = schema.get("minimum", value), schema.get("maximum", value)
        inside = low <= value <= high and not ("exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]) and not ("exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"])
        return inside and ("multipleOf" not in schema or (_exact(value) / _exact(schema["multipleOf"])).denominator == 1)
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", ())) or not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            return False
        return all(valid(v, known.get(k, others)) for k, v in value.items())
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return False
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            return False
        return all(valid(v, schema.get("items", True)) for v in value)
    return True


def _id(value) -> str:
    return _whole(value if isinstance(value, str) else canonical(value))


def _references(value) -> set[str]:
    found, stack = set(), [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if set(v) == {"$result"}:
                found.add(_id(v["$result"]))
            else:
                stack += v.values()
        elif isinstance(v, list):
            stack += v
    return found


def format_message(role: str | None, text: str | None, schemas: Mapping[str, Mapping]) -> dict:
    """Canonical JSON of a message, and its calls, result and needs."""
    text = text or ""
    loaded = _loads(text) if text.lstrip()[:1] == "{" else None
    out = {"calls": [], "result": None, "needs": [], "n_valid": 0, "n_invalid": 0, "n_unknown": 0}
    body = {"role": role, "content": text}
    if isinstance(loaded, dict) and isinstance(loaded.get("tool_calls"), list):
        calls, needs = [], set()
        for call in loaded["tool_calls"]:
            if not isinstance(call, dict):
                continue
            args = call.get("arguments")
            args = _loads(args) if isinstance(args, str) else args
            name = call.get("name")
            schema = schemas.get(name) if isinstance(name, str) else None
            verdict = "n_unknown" if schema is None else "n_valid" if valid(args, schema) else "n_invalid"
            out[verdict] += 1
            needs |= _references(args)
            if call.get("id") is not None:
                out["calls"].append(_id(call["id"]))
            calls.append({"id": call.get("id"), "name": name, "arguments": args})
        body = {"role": role, "content": loaded.get("content"), "tool_calls": calls}
        out["needs"] = sorted(needs)
    elif role == "tool" and isinstance(loaded, dict) and loaded.get("tool_call_id") is not None:
        out["result"] = _id(loaded["tool_call_id"])
        body = {"role": role, "tool_call_id": loaded["tool_call_id"], "content": loaded.get("content")}
    out["json"] = _whole(canonical(body))
    return out


_SCHEMA = "row string, conv_id long, turn long, role string, json string, calls array<string>, result string, needs array<string>, n_valid long, n_invalid long, n_unknown long"


def format_chats(chats: DataFrame, schemas: Mapping[str, Mapping] | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message: conv_id, turn, role, anchor, depth, counts of calls and links, and its canonical JSON."""
    schemas = dict(schemas or {})
    for schema in schemas.values():
        check_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_message(r, t, schemas) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            kinds = {"json": pa.string(), "calls": pa.list_(pa.string()), "result": pa.string(), "needs": pa.list_(pa.string()), "n_valid": pa.int64(), "n_invalid": pa.int64(), "n_unknown": pa.int64()}
            # A message is named by its conversation, turn and content.
            rows = [f"{c}:{t}:{hash_}" for c, t, hash_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            columns = {"row": pa.array(rows), "conv_id": batch.column(0), "turn": batch.column(1), "role": batch.column(2)}
            columns |= {k: pa.array([m[k] for m in made], kind) for k, kind in kinds.items()}
            yield pa.RecordBatch.from_pydict(columns)

    source = chats.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    # xxhash64 skips nulls, so it gets the places of nulls, too.
    messages = spool(source.withColumn("mark", F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text")).mapInArrow(run, _SCHEMA), "chat-messages")

    # Hash join of calls and results by conversation and identifier; first of each identifier.
    keyed = messages.where("conv_id is not null and turn is not null")
    calls = keyed.select("conv_id", "turn", "row", F.posexplode("calls").alias("place", "call"))
    results = keyed.where("result is not null").select("conv_id", "turn", "row", F.col("result").alias("call"))
    first_call = calls.groupBy("conv_id", "call").agg(F.min(F.struct("turn", "place", "row")).alias("c"), F.count("*").alias("n"))
    first_result = results.groupBy("conv_id", "call").agg(F.min(F.struct("turn", "row")).alias("r"), F.count("*").alias("n_r"))
    linked = spool(first_call.join(first_result, ["conv_id", "call"], "full"), "chat-links")

    call_side = linked.where("c is not null").groupBy(F.col("c.row").alias("row")).agg(
        F.count("r").alias("n_linked"), (F.count("*") - F.count("r")).alias("n_unanswered"), F.sum(F.col("n") - 1).alias("n_duplicates")
    )
    result_side = linked.where("r is not null").select(F.col("r.row").alias("row"), F.col("c").isNull().alias("orphan"))
    result_side = result_side.groupBy("row").agg(F.max(F.col("orphan").cast("long")).alias("n_orphans"))

    # Dependencies between messages: result after its call, call after the results its arguments name.
    both = linked.where("c is not null and r is not null")
    after_call = both.select("conv_id", F.col("r.row").alias("row"), F.col("r.turn").alias("turn"), F.col("c.row").alias("on"), F.col("c.turn").alias("on_turn"))
    named = keyed.select("conv_id", "row", "turn", F.explode("needs").alias("call")).join(both, ["conv_id", "call"])
    after_result = named.select("conv_id", "row", "turn", F.col("r.row").alias("on"), F.col("r.turn").alias("on_turn"))
    edges = spool(after_call.union(after_result).where("row <> on").distinct(), "chat-edges")
    # Conversations of few links are ordered in one task each, larger ones by joins.
    sizes = edges.groupBy("conv_id").agg(F.count("*").alias("n"))
    few = edges.join(sizes.where(F.col("n") <= GROUP_LINKS), "conv_id", "left_semi")
    placed = few.groupBy("conv_id").applyInArrow(_ordered, "row string, anchor long, depth int, cycle boolean")
    large = spool(edges.join(sizes.where(F.col("n") > GROUP_LINKS), "conv_id", "left_semi"), "chat-large")
    if large.limit(1).count():
        placed = placed.unionByName(_anchors(large))

    out = messages.join(call_side, "row", "left").join(result_side, "row", "left").join(placed, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", "turn", "role", F.coalesce("anchor", "turn").alias("anchor"),
        F.when(F.coalesce("cycle", F.lit(False)), F.lit(None)).otherwise(F.coalesce("depth", F.lit(0))).cast("long").alias("depth"),
        F.size("calls").cast("long").alias("n_calls"), zero("n_linked"), zero("n_unanswered"), zero("n_duplicates"), zero("n_orphans"),
        "n_valid", "n_invalid", "n_unknown", "json",
    )


def _ordered(links: pa.Table) -> pa.Table:
    """row, anchor, depth, cycle of the messages of one conversation, by its strongly connected components.

    A component is complete after all that it depends on.
    """
    turn: dict[str, int] = {}
    on: dict[str, list[str]] = {}
    columns = (links[c].to_pylist() for c in ("row", "turn", "on", "on_turn"))
    for row, t, other, other_turn in zip(*columns, strict=True):
        turn[row], turn[other] = t, other_turn
        on.setdefault(row, []).append(other)
    number, low, place = {}, {}, {}
    stack: list[str] = []
    held: set[str] = set()
    for root in turn:
        work = [] if root in number else [(root, iter(on.get(root, ())))]
        while work:
            row, ahead = work[-1]
            if row not in number:
                number[row] = low[row] = len(number)
                stack.append(row)
                held.add(row)
            for other in ahead:
                if other not in number:
                    work.append((other, iter(on.get(other, ()))))
                    break
                if other in held:
                    low[row] = min(low[row], number[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[row])
                if low[row] == number[row]:
                    at = stack.index(row) if stack[-1] != row else len(stack) - 1
                    members, stack[at:] = stack[at:], []
                    held.difference_update(members)
                    if len(members) > 1:
                        place.update((m, (turn[m], 0, True)) for m in members)
                    else:
                        anchor, depth = max([(turn[row], 0), *((place[o][0], place[o][1] + 1) for o in on.get(row, ()))])
                        place[row] = anchor, depth, False
    rows = [(row, *place[row]) for row in turn]
    kinds = (("row", pa.string()), ("anchor", pa.int64()), ("depth", pa.int32()), ("cycle", pa.bool_()))
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})


def _trimmed(live: DataFrame) -> DataFrame:
    """Links (row, on) without messages that wait for nothing or that nothing waits for, again and again: what is left lies on or between cycles."""
    before = live.count()
    while before:
        inner = live.select("row").intersect(live.select(F.col("on").alias("row")))
        after = live.join(inner, "row", "left_semi").join(inner.select(F.col("row").alias("on")), "on", "left_semi")
        after = spool(after.select("row", "on"), "chat-live")
        unspool(live)
        live, n = after, after.count()
        if n == before:
            break
        before = n
    return live


def _cycles(edges: DataFrame) -> DataFrame:
    """row of each message in a cycle: strongly connected components of two or more, by the largest name that each message reaches."""
    # A cycle needs a message before one that it depends on.
    suspects = edges.where("on_turn >= turn").select("conv_id").distinct()
    live = _trimmed(spool(edges.join(suspects, "conv_id", "left_semi").select("row", "on").distinct(), "chat-live"))
    found = live.select("row").limit(0)
    while live.limit(1).count():
        label = spool(live.select("row").union(live.select("on")).distinct().select("row", F.col("row").alias("c")), "chat-reach")
        moved = 1
        while moved:
            best = live.join(label.select(F.col("row").alias("on"), F.col("c").alias("m")), "on").groupBy("row").agg(F.max("m").alias("m"))
            after = spool(label.join(best, "row", "left").select("row", F.greatest("c", "m").alias("c"), F.coalesce(F.col("m") > F.col("c"), F.lit(False)).alias("moved")), "chat-reach")
            moved = after.where("moved").limit(1).count()
            unspool(label)
            label = after.drop("moved")
            label._spool_path = after._spool_path
        # Of the messages that reach the same largest one, those that it reaches in turn.
        ends = label.select(F.col("row").alias("on"), F.col("c").alias("to"))
        inside = spool(live.join(label, "row").join(ends, "on").where(F.col("c") == F.col("to")).select("row", "on", "c"), "chat-inside")
        held = new = spool(label.where(F.col("row") == F.col("c")), "chat-held")
        while new.limit(1).count():
            new = spool(inside.join(new.select("row"), "row").select(F.col("on").alias("row"), "c").distinct().join(held.select("row"), "row", "left_anti"), "chat-new")
            held = spool(held.unionByName(new), "chat-held")
        large = held.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
        found = spool(found.union(held.join(large, "c").select("row")), "chat-cycles")
        rest = live.join(held.select("row"), "row", "left_anti").join(held.select(F.col("row").alias("on")), "on", "left_anti")
        live = _trimmed(spool(rest.select("row", "on"), "chat-live"))
    return found


def _anchors(edges: DataFrame) -> DataFrame:
    """row, anchor, depth, cycle for messages with dependencies: rounds of relaxation until nothing moves; messages in cycles stay."""
    own = edges.select("row", "turn").union(edges.select(F.col("on").alias("row"), F.col("on_turn").alias("turn"))).distinct()
    cycles = _cycles(edges).withColumn("cycle", F.lit(True))
    now = spool(own.join(cycles, "row", "left").select("row", F.col("turn").alias("anchor"), F.lit(0).alias("depth"), F.coalesce("cycle", F.lit(False)).alias("cycle")), "chat-anchors")
    edges = spool(edges.select("row", "on").join(cycles, "row", "left_anti"), "chat-acyclic")
    changed = edges.limit(1).count()
    while changed:
        before = now.select(F.col("row").alias("on"), F.col("anchor").alias("a"), F.col("depth").alias("d"))
        best = edges.join(before, "on").groupBy("row").agg(F.max(F.struct("a", (F.col("d") + 1).alias("d"))).alias("b"))
        joined = now.join(best, "row", "left")
        # A dependency at an earlier anchor leaves the message where it is.
        later = (F.col("b.a") > F.col("anchor")) | ((F.col("b.a") == F.col("anchor")) & (F.col("b.d") > F.col("depth")))
        moved = F.coalesce(later, F.lit(False))
        after = spool(joined.select("row", F.when(moved, F.col("b.a")).otherwise(F.col("anchor")).alias("anchor"), F.when(moved, F.col("b.d")).otherwise(F.col("depth")).alias("depth"), "cycle", moved.alias("moved")), "chat-anchors")
        changed = after.where("moved").limit(1).count()
        unspool(now)
        now = after.drop("moved")
        now._spool_path = after._spool_path
    return now


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"), SCHEMAS)
