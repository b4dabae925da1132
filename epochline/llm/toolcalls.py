"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on conversation and identifier. A call may refer to results of
others, as {"$result": identifier} anywhere in its arguments, and has to stand behind them. Arguments are
validated against a schema per tool, and each call becomes one line of canonical JSON: keys sorted, no
spare blanks, numbers in their shortest form.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochline.llm.arrow_text import small_batches
from epochline.operators.ordered import Position, with_ordered
from epochline.session import settle

#: Half of a surrogate pair, which JSON can escape and UTF-8 can't hold.
HALF = re.compile("[\ud800-\udfff]")
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """A value as JSON with sorted keys; whole floats become integers. NaN and infinities are null, half surrogate pairs stay escapes."""

    def plain(v):
        if isinstance(v, float):
            return None if not math.isfinite(v) else int(v) if v == int(v) and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def references(value: object) -> list[str]:
    """Identifiers of the results that a value refers to, in order of appearance."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        return [r for k in sorted(value) for r in references(value[k])]
    return [r for x in value for r in references(x)] if isinstance(value, list) else []


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema with type, enum, properties, required, additionalProperties, items, minimum, maximum, minLength, maxLength.

    A reference to a result fits any schema.
    """
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []
    kind, found = schema.get("type"), []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    whole = number and (isinstance(value, int) or value.is_integer())
    if kind and not (whole if kind == "integer" else number if kind == "number" else isinstance(value, _TYPES[kind])):
        return [f"{at}: not {kind}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{at}: not in enum")
    if number:
        found += [f"{at}: under {schema['minimum']}"] if value < schema.get("minimum", -math.inf) else []
        found += [f"{at}: over {schema['maximum']}"] if value > schema.get("maximum", math.inf) else []
    if isinstance(value, str):
        found += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        found += [f"{at}: too long"] if len(value) > schema.get("maxLength", math.inf) else []
    if isinstance(value, list) and "items" in schema:
        found += [e for i, x in enumerate(value) for e in violations(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    return found


def _utf8(text: str) -> str:
    return HALF.sub("\ufffd", text)


def _parse(schemas: dict[str, dict]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, refs, errors = [], [], []
            for name, arguments in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                try:
                    value = json.loads(arguments if arguments is not None else "{}")
                    made = canonical(value), list(dict.fromkeys(map(_utf8, references(value))))
                    broken = [_utf8(e) for e in violations(value, schemas[name])] if name in schemas else ["unknown tool"]
                except RecursionError:
                    made, broken = (None, []), ["$: nested too deep"]
                except ValueError:  # no JSON, or a number of more digits than Python converts
                    made, broken = (None, []), ["$: not JSON"]
                text.append(made[0])
                refs.append(made[1])
                errors.append(broken)
            strings = pa.list_(pa.string())
            yield pa.record_batch(
                [*batch.columns[:4], pa.array(text, pa.string()), pa.array(refs, strings), pa.array(errors, strings)],
                ["conv", "id", "seq", "name", "arguments", "refs", "errors"],
            )

    return build


def _positions(calls: DataFrame) -> DataFrame:
    """`pos` and `level` per call: calls sorted by (pos, level, seq) stand behind those they refer to; `cyclic` marks those that can't.

    A call's pos is the greatest seq among it and all it depends on. Logs are mostly in order: only calls
    that refer to a later one move, in as many rounds as such references follow one another.
    """
    edges = settle(calls.select("conv", F.col("id").alias("of"), F.explode("refs").alias("to")).distinct(), "references")
    here = calls.select("conv", "id", "seq", F.col("seq").alias("pos"), F.lit(0).cast("long").alias("level"), F.lit(0).alias("last"))
    here, rounds = settle(here, "positions"), 0
    while True:
        below = edges.alias("e").join(here.alias("p"), F.col("e.conv").eqNullSafe(F.col("p.conv")) & (F.col("e.to") == F.col("p.id")))
        best = below.groupBy(F.col("e.conv").alias("bc"), F.col("e.of").alias("of")).agg(F.max(F.struct("p.pos", "p.level")).alias("best"))
        joined = here.join(best, F.col("conv").eqNullSafe(F.col("bc")) & (F.col("id") == F.col("of")), "left")
        behind = F.col("best.pos") >= F.col("pos")
        pos = F.when(behind, F.col("best.pos")).otherwise(F.col("pos"))
        level = F.when(behind, F.greatest(F.when(F.col("best.pos") == F.col("pos"), F.col("level")).otherwise(F.lit(0)), F.col("best.level") + 1)).otherwise(F.col("level"))
        moved = (F.coalesce(pos, F.lit(-1)) != F.coalesce("pos", F.lit(-1))) | (level != F.col("level"))
        rounds += 1
        last = F.when(moved, F.lit(rounds)).otherwise(F.col("last")).alias("last")
        here = settle(joined.select("conv", "id", "seq", pos.alias("pos"), level.alias("level"), last), "positions")
        active = here.where("last > 0").groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last")).where(F.col("last") == rounds)
        most = active.agg(F.max("n")).first()[0]
        # Without a cycle, a call that moves in round n ends a path of n calls of its conversation that have all
        # moved, so none does after round `most`; a cycle that goes on moves each of its calls in as many more.
        if not most or rounds > 2 * most:
            return here.select("conv", "id", "seq", "pos", "level", (F.col("last") > (most or rounds)).alias("cyclic"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, position, status, valid, errors, cyclic, json) for calls (conv_id, call_id, seq, name, arguments) and results (conv_id, call_id, seq, content).

    Arguments are JSON text; null is {}. `status` is linked, no_result, no_call (a result whose call is
    missing) or repeated (a call or result whose identifier came before in the conversation; it links with
    nothing). A null identifier links with nothing. `position` counts the calls of a conversation from 1, each
    behind those whose results it refers to, else by seq; only rows with status linked or no_result have one.
    Calls that a cycle of references keeps from a place are `cyclic` and come in the order in which they were left. Arguments that
    are no JSON, are nested deeper than Python reads or hold a number of thousands of digits are errors and have null as
    arguments. Very long texts are handled a row at a time; other columns are not looked at. A conversation that holds much
    of the rows is numbered in segments.
    """
    small_batches(calls.sparkSession)
    rows = calls.select(F.col("conv_id").alias("conv"), F.col("call_id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"))
    kind = rows.schema["conv"].dataType.simpleString()
    parsed = rows.mapInArrow(_parse(schemas), f"conv {kind}, id string, seq long, name string, arguments string, refs array<string>, errors array<string>")
    replies = results.select(F.col("conv_id").alias("conv"), F.col("call_id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), F.col("content").cast("string").alias("content"))

    def numbered(df: DataFrame, *ties: str) -> DataFrame:
        return df.withColumn("copy", F.when(F.col("id").isNull(), 1).otherwise(F.row_number().over(Window.partitionBy("conv", "id").orderBy("seq", *ties))))

    calls_ = settle(numbered(parsed, "name", "arguments"), "calls")
    replies = numbered(replies, "content").alias("r")
    places = _positions(calls_.where("copy = 1 and id is not null").select("conv", "id", "seq", "refs")).alias("p")
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.id") == F.col(f"{b}.id"))
    first = F.col("c.copy") == F.lit(1)
    linked = calls_.alias("c").join(replies.where("r.copy = 1"), same("c", "r") & first, "left").join(places, same("c", "p") & first, "left")
    body = linked.select(
        F.col("c.conv").alias("conv_id"),
        F.col("c.id").alias("call_id"),
        F.col("c.seq").alias("seq"),
        F.coalesce("p.pos", "c.seq").alias("pos"),
        F.coalesce("p.level", F.lit(0)).alias("level"),
        F.when(~first, "repeated").when(F.col("r.id").isNull(), "no_result").otherwise("linked").alias("status"),
        "c.errors",
        F.coalesce("p.cyclic", F.lit(False)).alias("cyclic"),
        "c.name",
        "c.arguments",
        "r.content",
    )
    alone = replies.join(calls_.where("copy = 1").alias("c"), same("r", "c") & (F.col("r.copy") == 1), "left").where("c.id is null")
    orphans = alone.select(F.col("r.conv").alias("conv_id"), F.col("r.id").alias("call_id"), F.col("r.seq").alias("seq"), F.when(F.col("r.copy") > 1, "repeated").otherwise("no_call").alias("status"), "r.content")
    whole = body.unionByName(orphans, allowMissingColumns=True)
    stands = F.col("status").isin("linked", "no_result")
    whole = settle(whole.withColumn("stands", stands), "linked")
    ties = ["level", "seq", "call_id", "name", "arguments"]
    whole = with_ordered(whole, "pos", {"position": Position()}, ["conv_id", "stands"], ties)
    whole = whole.withColumn("position", F.when(F.col("stands"), F.col("position")).cast("int"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for id_, name, arguments, content in zip(*(batch.column(c).to_pylist() for c in (1, 6, 7, 8))):
                line = {"id": id_, "name": name, "result": content}
                head = canonical(line)
                lines.append(f'{{"arguments":{arguments if arguments is not None else "null"},{head[1:]}')
            yield pa.record_batch([*batch.columns[:6], pa.array(lines, pa.string())], ["conv_id", "call_id", "position", "status", "errors", "cyclic", "json"])

    out = whole.select("conv_id", "call_id", "position", "status", "errors", "cyclic", "name", "arguments", "content")
    made = out.mapInArrow(write, f"conv_id {kind}, call_id string, position int, status string, errors array<string>, cyclic boolean, json string")
    return made.select("conv_id", "call_id", "position", "status", (F.size(F.coalesce("errors", F.array())) == 0).alias("valid"), "errors", "cyclic", "json")
