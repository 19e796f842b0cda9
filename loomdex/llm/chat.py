"""Chat formatting with tool-call linking.

A message is a row (conv_id, turn, role, text). A text that is a JSON object with a list
``tool_calls`` ({id, name, arguments} or {id, function: {name, arguments}}) makes calls; one
with ``tool_call_id`` is a result; one with a list ``tools`` ({name, parameters} or {function:
{name, parameters}}) declares its conversation's tools. Anything else is plain content. JSON
is strict: NaN, infinities and numbers beyond a double make a text plain content. Lone
surrogates, which UTF-8 cannot hold, become U+FFFD.

* Results are hash-joined to calls on (conv_id, call id). The first call of an id counts;
  results without a call are orphans.
* Order: a result comes after its call, and a call whose arguments hold {"$ref": id} after
  what it refers to. Messages keep their turns otherwise. This needs work only in conversations
  with an edge against the turns: those of up to LOCAL edges are sorted topologically in one
  task each, larger ones by their connected groups, and groups of more edges by Kahn's rounds
  over all of them at once (one round for each step of the longest chain). Messages on or
  behind a cycle keep their turns and are counted.
* Arguments are validated against the tool's JSON Schema (type, properties, required,
  additionalProperties, items, enum, minimum, maximum, minLength, maxLength): calls are
  hash-joined to the declarations of their conversation on (conv_id, name).
* Messages are written as canonical JSON: sorted keys, no blanks, UTF-8.

A conversation is returned in parts of ``part_rows`` messages, so one conversation with any
number of turns never meets in one task.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .ranks import dealt, running
from .scratch import Scratch, broadcast_if_small
from .stream import frugal, runs

#: Edges of a connected group that one task sorts, and rows of a bucket of messages.
LOCAL = 200_000
ROWS_A_BUCKET = 20_000
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return text if text.isascii() else whole(text)


def whole(text: str) -> str:
    """With U+FFFD for lone surrogates."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _finite(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise ValueError("number beyond a double")
    return x


def _refused(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(text: str):
    """Strict JSON; ValueError or RecursionError otherwise."""
    return json.loads(text, parse_constant=_refused, parse_float=_finite)


def _is(kind: str, x) -> bool:
    if kind == "integer":
        return isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer()
    if kind == "number":
        return isinstance(x, (int, float)) and not isinstance(x, bool)
    return isinstance(x, _TYPES[kind]) if kind in _TYPES else True


def problems(value, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a schema. {"$ref": id} stands for a value yet to come."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(k, value) for k in kinds):
        return [f"{path}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += problems(v, known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    elif isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            out += problems(v, schema["items"], f"{path}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{path}: range")
    return out


def references(value) -> list[str]:
    out, work = [], [value]
    while work:
        x = work.pop()
        if isinstance(x, dict):
            if set(x) == {"$ref"} and isinstance(x["$ref"], str):
                out.append(x["$ref"])
            else:
                work += x.values()
        elif isinstance(x, list):
            work += x
    return out


def _named(entry) -> tuple[str | None, dict]:
    """Name and fields of a call or a tool, whether or not they are below ``function``."""
    entry = entry if isinstance(entry, dict) else {}
    inner = entry["function"] if isinstance(entry.get("function"), dict) else entry
    name = inner.get("name")
    return (whole(name) if isinstance(name, str) else None), inner


def _call(entry) -> tuple[dict, dict]:
    """(call as a row, call as it is written)."""
    name, fields = _named(entry)
    args, error = fields.get("arguments"), None
    if isinstance(args, str):
        try:
            args = parse(args)
        except ValueError:
            error = "$: arguments are not JSON"
    ident = entry.get("id") if isinstance(entry, dict) else None
    ident = whole(ident) if isinstance(ident, str) else None
    row = {"id": ident, "name": name, "arguments": canonical(args), "error": error, "refs": sorted({whole(r) for r in references(args)})}
    return row, {"arguments": args, "id": ident, "name": name}


def parse_message(role: str | None, text: str | None) -> dict:
    """One message: json, calls [{id, name, arguments, error, refs}], result id or None and
    declared tools [{name, schema}]."""
    plain = {"json": canonical({"content": text, "role": role}), "calls": [], "result": None, "tools": []}
    if not text or text.lstrip()[:1] != "{":
        return plain
    try:
        body = parse(text)
        content = body.get("content")
        if isinstance(body.get("tool_calls"), list):
            both = [_call(c) for c in body["tool_calls"]]
            return plain | {"json": canonical({"content": content, "role": role, "tool_calls": [c for _, c in both]}), "calls": [r for r, _ in both]}
        if isinstance(body.get("tool_call_id"), str):
            ident = whole(body["tool_call_id"])
            return plain | {"json": canonical({"content": content, "role": role, "tool_call_id": ident}), "result": ident}
        if isinstance(body.get("tools"), list):
            named = [_named(t) for t in body["tools"]]
            tools = [{"name": n, "schema": canonical(f["parameters"] if isinstance(f.get("parameters"), dict) else {})} for n, f in named if n is not None]
            return plain | {"json": canonical({"content": content, "role": role, "tools": body["tools"]}), "tools": tools}
    except (ValueError, RecursionError):  # not JSON, or too deep to be written again
        pass
    return plain


_CALL = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("error", pa.string()), ("refs", pa.list_(pa.string()))])
_CALL_SQL = "array<struct<id:string,name:string,arguments:string,error:string,refs:array<string>>>"
_TOOL = pa.struct([("name", pa.string()), ("schema", pa.string())])


def _parse(batches):
    for batch in batches:
        got = [parse_message(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
        kinds = {"json": pa.string(), "calls": pa.list_(_CALL), "result": pa.string(), "tools": pa.list_(_TOOL)}
        kept = ["conv_id", "turn", "role", "node"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array([g[c] for g in got], k) for c, k in kinds.items()], names=[*kept, *kinds])


def _check(batches):
    """Whether each call breaks its tool's schema; a schema that cannot be used allows all."""
    for batch in batches:
        bad = []
        for args, schema in zip(batch.column("arguments").to_pylist(), batch.column("schema").to_pylist()):
            try:
                bad.append(bool(problems(json.loads(args), json.loads(schema))))
            except (TypeError, ValueError, AttributeError, RecursionError):
                bad.append(False)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bad, pa.bool_())], names=["node", "bad"])


def topological(parent: np.ndarray, child: np.ndarray, parent_turn: np.ndarray, child_turn: np.ndarray) -> list[tuple[int, int | None, int | None]]:
    """(node, at, depth) of the nodes on some edges: at = the latest turn among a node and all
    before it, depth = its place among those of the same ``at``; None for nodes on or behind a
    cycle."""
    turn = dict(zip(parent.tolist(), parent_turn.tolist())) | dict(zip(child.tolist(), child_turn.tolist()))
    waits, after = defaultdict(int), defaultdict(list)
    for p, c in set(zip(parent.tolist(), child.tolist())):
        waits[c] += 1
        after[p].append(c)
    place: dict[int, tuple[int, int]] = {}
    last: dict[int, tuple[int, int]] = {}
    ready = [n for n in turn if not waits[n]]
    while ready:
        n = ready.pop()
        seen = last.get(n)
        place[n] = (turn[n], 0) if seen is None or turn[n] > seen[0] else (seen[0], seen[1] + 1)
        for c in after[n]:
            last[c] = max(last.get(c, place[n]), place[n])
            waits[c] -= 1
            if not waits[c]:
                ready.append(c)
    return [(n, *place.get(n, (None, None))) for n in turn]


def _sorted_groups(batches):
    for group in runs(batches, ["comp"]):
        rows = topological(*(group.column(c).to_numpy() for c in ("parent", "child", "parent_turn", "child_turn")))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["node", "at", "depth"])


def _rounds(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The same as ``topological`` over all edges at once, one round for each step."""
    nodes = edges.select(F.col("child").alias("node"), F.col("child_turn").alias("turn")).union(edges.select("parent", "parent_turn")).distinct()
    nodes = scratch.table(nodes, "nodes")
    open_ = scratch.table(edges.select("parent", "child").distinct(), "open-0")
    waiting = open_.select(F.col("child").alias("node")).distinct()
    done = scratch.table(nodes.join(waiting, "node", "left_anti").select("node", F.col("turn").alias("at"), F.lit(0).cast("long").alias("depth")), "done-0")
    step = 0
    while True:
        step += 1
        state = open_.join(done, open_["parent"] == done["node"], "left").groupBy("child").agg(
            F.bool_and(F.col("node").isNotNull()).alias("ready"), F.max(F.struct("at", "depth")).alias("last")
        )
        ready = state.where("ready").join(nodes, F.col("child") == nodes["node"]).join(done.select(F.col("node").alias("had")), F.col("child") == F.col("had"), "left_anti")
        later = F.col("turn") > F.col("last.at")
        new = scratch.table(ready.select("node", F.greatest("turn", F.col("last.at")).alias("at"), F.when(later, F.lit(0).cast("long")).otherwise(F.col("last.depth") + 1).alias("depth")), f"new-{step}")
        if not new.limit(1).count():
            break
        done = scratch.table(done.union(new), f"done-{step}")
    return nodes.join(done, "node", "left").select("node", "at", "depth")


def _levels(edges: DataFrame, scratch: Scratch, local: int) -> DataFrame:
    """(node, at, depth) of the nodes of groups of edges (conv, parent, child, parent_turn,
    child_turn) of which one at least runs against the turns. A group is a conversation (by a
    hash; two that share it do no harm) or, in one of over ``local`` edges, what is connected."""
    turned = F.bool_or(F.col("parent_turn") >= F.col("child_turn")).alias("turned")
    fields = ["comp", "parent", "child", "parent_turn", "child_turn"]
    groups = scratch.table(edges.groupBy("conv").agg(F.count("*").alias("n"), turned).where("turned"), "turned")
    small = edges.join(groups.where(F.col("n") <= local).select("conv"), "conv").withColumnRenamed("conv", "comp").select(*fields)
    over = groups.where(F.col("n") > local).select("conv")
    if not over.limit(1).count():
        return _sorted(small)
    hot = scratch.table(edges.join(broadcast_if_small(over), "conv"), "hot")
    comp = connected_components(hot.select(F.col("parent").alias("u"), F.col("child").alias("v")), scratch, "groups")
    placed = scratch.table(hot.join(comp.withColumnRenamed("node", "child"), "child").select(*fields), "placed")
    parts = scratch.table(placed.groupBy("comp").agg(F.count("*").alias("n"), turned).where("turned"), "parts")
    out = _sorted(small.union(placed.join(parts.where(F.col("n") <= local).select("comp"), "comp").select(*fields)))
    large = parts.where(F.col("n") > local).select("comp")
    if large.limit(1).count():
        out = out.union(_rounds(scratch.table(placed.join(large, "comp").drop("comp"), "large"), scratch))
    return out


def _sorted(edges: DataFrame) -> DataFrame:
    return edges.repartition("comp").sortWithinPartitions("comp").mapInArrow(frugal(_sorted_groups), "node long, at long, depth long")


def format_conversations(messages: DataFrame, tools: dict[str, dict] | None = None, part_rows: int = 256, local: int = LOCAL) -> DataFrame:
    """conv_id, part int, n_messages, n_calls, n_invalid, n_linked, n_orphans, n_cyclic (all
    long) and json: {"conv_id", "messages": [...], "part"} in canonical form.

    ``tools`` maps a tool's name to the JSON Schema of its arguments in every conversation; a
    conversation's own declarations go before, the first one of a name. Where any tool is
    known, calls of others are invalid. n_linked counts results that have a call, n_orphans
    those that have none. Null turns come first, ties go by role and SHA-256; a null text is
    content null; a null conv_id is a conversation of its own. Repeated rows are kept, each a
    message of its own. An empty table gives no rows. Other columns of ``messages`` are ignored.
    """
    spark = messages.sparkSession
    with Scratch(spark, "chat") as scratch:
        kind = messages.schema["conv_id"].dataType.simpleString()
        rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        rows = rows.withColumn("node", F.monotonically_increasing_id())  # written below, so it stays
        shape = f"conv_id {kind}, turn long, role string, node long, json string, calls {_CALL_SQL}, result string, tools array<struct<name:string,schema:string>>"
        parsed = scratch.table(rows.mapInArrow(frugal(_parse), shape), "parsed")
        turn = F.coalesce("turn", F.lit(-(1 << 62)))
        order = [turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.sha2("json", 256).alias("text")]  # ties among equal rows go by node
        calls = parsed.where(F.size("calls") > 0).select("conv_id", *order, "node", F.posexplode("calls").alias("nth", "call")).select("conv_id", "turn", "role", "text", "node", "nth", "call.*")
        calls = scratch.table(calls, "calls")

        declared = parsed.where(F.size("tools") > 0).select("conv_id", *order, "node", F.posexplode("tools").alias("nth", "tool"))
        declared = declared.groupBy("conv_id", F.col("tool.name").alias("tool")).agg(F.min(F.struct("turn", "role", "text", "node", "nth", F.col("tool.schema").alias("schema")))["schema"].alias("schema"))
        declared = scratch.table(declared.select(F.col("conv_id").alias("dc"), "tool", "schema"), "declared")
        ruled = F.broadcast(spark.createDataFrame([(n, canonical(x)) for n, x in (tools or {}).items()], "general string, rule string"))  # the caller's
        known = declared.select(F.col("dc").alias("kc")).distinct().withColumn("own", F.lit(True))
        checked = calls.where("error is null").join(declared, F.col("conv_id").eqNullSafe(F.col("dc")) & (F.col("name") == F.col("tool")), "left")
        checked = checked.join(ruled, F.col("name") == F.col("general"), "left").withColumn("schema", F.coalesce("schema", "rule"))
        stray = checked.where("schema is null").join(known, F.col("conv_id").eqNullSafe(F.col("kc")), "left").where(F.coalesce("own", F.lit(bool(tools)))).select("node")
        broken = checked.where("schema is not null").select("node", "arguments", "schema").mapInArrow(frugal(_check), "node long, bad boolean").where("bad").select("node")
        invalid = calls.where("error is not null").select("node").union(stray).union(broken).groupBy("node").agg(F.count("*").alias("invalid"))

        identified = calls.where("id is not null")
        first = identified.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "role", "text", "nth", "node")).alias("c")).select(F.col("conv_id").alias("cc"), F.col("id").alias("ci"), F.col("c.node").alias("call_node"), F.col("c.turn").alias("call_turn"))
        first = scratch.table(first, "first")
        results = parsed.where("result is not null").select("conv_id", *order, "node", "result")
        tied = scratch.table(results.join(first, results["conv_id"].eqNullSafe(first["cc"]) & (results["result"] == first["ci"]), "left"), "tied")
        to_call = tied.where("call_node is not null and call_node != node").select(F.xxhash64("conv_id").alias("conv"), F.col("call_node").alias("parent"), F.col("node").alias("child"), F.col("call_turn").alias("parent_turn"), F.col("turn").alias("child_turn"))
        refs = calls.select("conv_id", "turn", "node", F.explode("refs").alias("ref"))
        answers = tied.where("call_node is not null").groupBy("conv_id", "result").agg(F.min(F.struct("turn", "role", "text", "node")).alias("a"))
        target = first.join(answers, first["cc"].eqNullSafe(answers["conv_id"]) & (first["ci"] == answers["result"]), "left").select("cc", "ci", F.coalesce("a.node", "call_node").alias("parent"), F.coalesce("a.turn", "call_turn").alias("parent_turn"))
        to_ref = refs.join(target, refs["conv_id"].eqNullSafe(target["cc"]) & (refs["ref"] == target["ci"])).where("parent != node").select(F.xxhash64("conv_id").alias("conv"), "parent", F.col("node").alias("child"), "parent_turn", F.col("turn").alias("child_turn"))
        edges = scratch.table(to_call.union(to_ref).distinct(), "edges")
        out = parsed.join(tied.select("node", F.col("call_node").isNotNull().alias("linked")), "node", "left").join(invalid, "node", "left")
        if edges.where("parent_turn >= child_turn").limit(1).count():
            levels = scratch.table(_levels(edges, scratch, local), "levels").select("node", F.col("at").alias("l_at"), F.col("depth").alias("l_depth"), F.lit(True).alias("on_edge"))
            out = out.join(levels, "node", "left")
        else:
            out = out.withColumns({"l_at": F.lit(None).cast("long"), "l_depth": F.lit(None).cast("long"), "on_edge": F.lit(None).cast("boolean")})
        at = F.coalesce("l_at", "turn")
        out = out.select(
            "conv_id", F.when(at > -(1 << 62), at).alias("at"), F.coalesce("l_depth", F.lit(0).cast("long")).alias("depth"), "turn", "role", "node", "json", F.sha2("json", 256).alias("tie"), F.size("calls").alias("calls"), F.coalesce("invalid", F.lit(0)).alias("invalid"),
            F.coalesce("linked", F.lit(False)).alias("linked"), (F.col("result").isNotNull() & ~F.coalesce("linked", F.lit(False))).alias("orphan"), (F.col("on_edge").isNotNull() & F.col("l_at").isNull()).alias("cyclic"),
        )
        along = ["at", "depth", "turn", "role", "tie", "node"]
        out = dealt(out, ["conv_id", *along], parsed.count(), ROWS_A_BUCKET, scratch, "ordered")
        placed = running(out, ["conv_id"], "__b", along, {"place": F.lit(1).cast("long")})
        placed = placed.withColumn("part", F.expr(f"cast(place div {part_rows} as int)"))
        count = lambda c: F.sum(F.col(c).cast("long"))
        parts = placed.groupBy("conv_id", "part").agg(
            F.count("*").alias("n_messages"), count("calls").alias("n_calls"), count("invalid").alias("n_invalid"), count("linked").alias("n_linked"),
            count("orphan").alias("n_orphans"), count("cyclic").alias("n_cyclic"), F.sort_array(F.collect_list(F.struct("place", "json"))).alias("m"),
        )
        body = F.concat(F.lit('{"conv_id":'), F.coalesce(F.to_json(F.struct("conv_id"), {"ignoreNullFields": "false"}).substr(F.lit(12), F.lit(1 << 30)), F.lit("")))
        head = F.regexp_replace(body, r"\}$", "")
        text = F.concat(head, F.lit(',"messages":['), F.array_join(F.transform("m", lambda x: x["json"]), ","), F.lit('],"part":'), F.col("part").cast("string"), F.lit("}"))
        return scratch.keep(parts.select("conv_id", "part", "n_messages", "n_calls", "n_invalid", "n_linked", "n_orphans", "n_cyclic", text.alias("json")))
