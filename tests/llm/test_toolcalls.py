import json
import random

from epochline.llm import queries, toolcalls
from epochline.operators import ordered
from tests.conftest import TESTDATA

SCHEMAS = {"f": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}, "s": {"type": "string", "maxLength": 3}}, "required": ["x"], "additionalProperties": False}}
CALLS = "conv_id long, call_id string, seq long, name string, arguments string, json string"
RESULTS = "conv_id long, call_id string, seq long, content string"


def run(spark, calls, results):
    c = spark.createDataFrame([(*x, "clash") for x in calls], CALLS).repartition(3)
    return toolcalls.link_calls(c, spark.createDataFrame(results, RESULTS), SCHEMAS).collect()


def test_links_order_and_json(spark):
    calls = [
        (1, "a", 1, "f", '{"x": {"$result": "c"}, "s": "é"}'),
        (1, "b", 2, "f", '{"x": 2.0}'),
        (1, "c", 3, "f", '{"x": {"$result": "b"}}'),
        (1, "b", 9, "f", '{"x": 5}'),
        (2, "a", 1, "f", '{"x": -1, "s": "long", "z": 1}'),
        (2, "d", 2, "g", None),
        (2, "e", 3, "f", "{broken"),
        (3, "p", 1, "f", '{"x": {"$result": "q"}}'),
        (3, "q", 2, "f", '{"x": {"$result": "p"}}'),
        (None, "n", 1, "f", '{"x": 1}'),
        (4, None, 1, "f", '{"x": 1}'),
    ]
    results = [(1, "a", 4, "A"), (1, "b", 5, "B"), (1, "b", 6, "B2"), (2, "zz", 1, "lost"), (None, "n", 2, "N"), (4, None, 2, "x"), (1, "c", 7, None)]
    got = run(spark, calls, results)
    one = sorted((r for r in got if r.conv_id == 1 and r.position), key=lambda r: r.position)
    assert [(r.call_id, r.status) for r in one] == [("b", "linked"), ("c", "linked"), ("a", "linked")]
    assert one[2].json == '{"arguments":{"s":"é","x":{"$result":"c"}},"id":"a","name":"f","result":"A"}'
    assert json.loads(one[0].json)["arguments"] == {"x": 2} and one[0].json.startswith('{"arguments":{"x":2},')
    assert sorted(r.status for r in got if r.conv_id == 1 and not r.position) == ["repeated", "repeated"]
    two = {r.call_id: r for r in got if r.conv_id == 2}
    assert two["a"].errors == ["$.s: too long", "$.x: under 0", "$.z: unknown"] and not two["a"].valid
    assert two["d"].errors == ["unknown tool"] and two["e"].errors == ["$: not JSON"] and two["zz"].status == "no_call"
    assert all(r.cyclic for r in got if r.conv_id == 3) and not any(r.cyclic for r in got if r.conv_id != 3)
    assert [r.status for r in got if r.conv_id is None] == ["linked"]
    assert sorted(r.status for r in got if r.conv_id == 4) == ["no_call", "no_result"]


def test_long_backward_chain_and_empty_tables(spark):
    calls = [(1, f"c{i}", i, "f", json.dumps({"x": {"$result": f"c{i + 1}"}} if i < 6 else {"x": 0})) for i in range(7)]
    got = sorted(run(spark, calls, []), key=lambda r: r.position)
    assert [r.call_id for r in got] == [f"c{i}" for i in range(6, -1, -1)] and {r.status for r in got} == {"no_result"}
    assert run(spark, [], []) == []


def test_logs_that_are_not_clean(spark):
    deep = "[" * 3000 + "]" * 3000
    calls = [
        (1, "a", 1, "f", '{"x": 1, "s": "\\ud800"}'),
        (1, "b", 2, "f", '{"x": ' + "9" * 400 + "}"),
        (1, "c", 3, "f", '{"x": ' + "9" * 6000 + "}"),
        (1, "d", 4, "f", '{"x": ' + deep + "}"),
        (1, "e", 5, "f", '{"x": 1e999}'),
        (1, "g", 6, "f", '{"x": {"$result": "\\udfff"}}'),
        (1, "h", 7, "f", '{"x": 1, "s": "' + "é" * 300_000 + '"}'),
    ]
    got = {r.call_id: r for r in run(spark, calls, [(1, "a", 9, "done")])}
    assert got["a"].valid and json.loads(got["a"].json)["arguments"]["s"] == "\ud800"
    assert got["b"].valid and json.loads(got["b"].json)["arguments"]["x"] == int("9" * 400)
    assert got["c"].errors == ["$: not JSON"] and got["d"].errors in (["$: nested too deep"], ["$: not JSON"]) and "null" in got["d"].json
    assert got["e"].errors == ["$.x: not integer"] and got["g"].valid and got["h"].errors == ["$.s: too long"]
    assert toolcalls.violations(True, {"enum": [1]}) == ["$: not in enum"] and toolcalls.violations(1.0, {"enum": [1]}) == []


def plain(calls, results):
    """Status and position of every call and result, one conversation after the other."""
    out = []
    for conv in {c[0] for c in calls} | {r[0] for r in results}:
        own = sorted((c for c in calls if c[0] == conv), key=lambda c: (c[2], c[3], c[4]))
        first = {}
        for c in own:
            first.setdefault(c[1], c)
        replies = {}
        for r in sorted((r for r in results if r[0] == conv), key=lambda r: (r[2], r[3])):
            out.append((conv, r[1], "repeated", None)) if r[1] in replies else replies.update({r[1]: r})
        out += [(conv, r, "no_call", None) for r in replies if r not in first]
        needs = {i: [x for x in toolcalls.references(json.loads(c[4])) if x in first] for i, c in first.items()}
        placed, pos = {}, {}

        def late(i):
            if i not in pos:
                pos[i] = (first[i][2], 0)
                for x in needs[i]:
                    p, level = late(x)
                    here, mine = pos[i]
                    if p >= here:
                        pos[i] = (p, max(mine if p == here else 0, level + 1))
            return pos[i]

        for n, i in enumerate(sorted(first, key=lambda i: (*late(i), first[i][2])), 1):  # noqa: B023
            placed[i] = n
        for i, c in first.items():
            out.append((conv, i, "linked" if i in replies else "no_result", placed[i]))
        out += [(conv, c[1], "repeated", None) for c in own if first[c[1]] is not c]
    return sorted(out, key=str)


def test_against_plain_linking(spark, monkeypatch):
    rng = random.Random(7)
    calls, results = [], []
    for conv in range(25):
        ids = [f"c{i}" for i in range(rng.randint(1, 9))]
        seqs = rng.sample(range(1, 100), len(ids) + 12)
        for n, i in enumerate(ids):  # no cycle: a call refers to ones of higher number
            refs = rng.sample(ids[n + 1 :], min(len(ids) - n - 1, rng.choice([0, 0, 1, 2])))
            calls.append((conv, i, seqs.pop(), "f", json.dumps({f"x{k}": {"$result": r} for k, r in enumerate(refs)})))
        for _ in range(rng.randint(0, 6)):
            results.append((conv, rng.choice([*ids, "zz"]), seqs.pop(), "r"))
        if rng.random() < 0.4:
            calls.append((conv, rng.choice(ids), seqs.pop(), "f", "{}"))
    got = sorted(((r.conv_id, r.call_id, r.status, r.position) for r in run(spark, calls, results)), key=str)
    assert got == plain(calls, results)
    monkeypatch.setattr(ordered.with_ordered, "__defaults__", tuple(2 if d == ordered.GROUP_LIMIT else d for d in ordered.with_ordered.__defaults__))
    again = sorted(((r.conv_id, r.call_id, r.status, r.position) for r in run(spark, calls, results)), key=str)
    assert again == got


def test_the_query_has_a_row_for_every_turn(spark):
    turns = spark.read.parquet(f"{TESTDATA}/conversations.parquet").collect()
    got = queries.op6_toolcalls(spark, TESTDATA).collect()
    assert len(got) == len(turns) - sum(r.status == "linked" for r in got)
    calls = [r for r in got if r.status in ("linked", "no_result") and r.position]
    assert len(calls) == sum(t.role in ("user", "system") for t in turns)
    linked = sum(r.status == "linked" for r in got)
    by_conv, answered = {}, 0
    for t in sorted(turns, key=lambda t: (t.conv_id, t.turn)):
        asked, done = by_conv.get(t.conv_id, (None, True))
        if t.role == "user":
            by_conv[t.conv_id] = (t.turn, False)
        elif t.role != "system" and asked is not None and not done:
            answered += 1
            by_conv[t.conv_id] = (asked, True)
    assert linked == answered


def test_canonical_and_references():
    assert toolcalls.canonical({"b": [1.0, 0.5, float("nan")], "a": {"z": None, "y": True}}) == '{"a":{"y":true,"z":null},"b":[1,0.5,null]}'
    assert toolcalls.references({"b": [{"$result": "x"}], "a": {"$result": "y"}, "c": {"$result": 1}}) == ["y", "x"]
