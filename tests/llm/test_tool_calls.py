import json

from quantloom.llm import tool_calls as T

SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "number", "minimum": 0}, "b": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}
CALLS = "conv_id long, turn long, pos int, call_id string, name string, arguments string, depends_on array<string>, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, json string"


def test_links_orders_and_validates(spark):
    calls = [
        (1, 1, 0, "x", "add", '{"b": ["q"],  "a": 1.5}', ["y"], "-"),  # stands before what it needs
        (1, 1, 1, "y", "add", '{"a": -1}', None, "-"),
        (1, 2, 0, "z", "add", '{"a": true, "c": 1}', ["x", "gone"], "-"),
        (2, 1, 0, "p", "add", "{bad", ["q"], "-"), (2, 1, 1, "q", "add", '{"a":0}', ["p"], "-"), (2, 2, 0, "r", "no", "{}", ["q"], "-"),
        (3, 1, 0, "x", "add", '{"a":2}', [], "-"), (3, 4, 0, "x", "add", '{"a":3}', [], "-"), (None, 1, 0, "x", "add", "{}", None, "-"), (3, 1, 0, None, None, None, None, "-"),
    ]
    results = [(1, 3, "x", "é\n\"", "-"), (1, 3, "nobody", "?", "-"), (3, 5, "x", None, "-"), (3, 6, "x", "late", "-"), (None, 1, "x", "?", "-")]
    got = T.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    assert len(got) == 10 + 5 - 2
    by = {(r.conv_id, r.call_id, r.status): r for r in got}
    assert by[1, "x", "linked"].layer == 1 and by[1, "y", "missing"].layer == 0 and by[1, "z", "missing"].layer == 2
    assert by[1, "x", "linked"].valid and by[1, "y", "missing"].errors == ["$.a: out of bounds"]
    assert by[1, "z", "missing"].errors == ["$.a: not of type number", "$.c: unknown"]
    assert by[1, "x", "linked"].json == '{"arguments":{"a":1.5,"b":["q"]},"id":"x","name":"add","result":"é\\n\\""}'
    assert json.loads(by[1, "x", "linked"].json)["result"] == 'é\n"'
    assert {r.status for r in got if r.conv_id == 2} == {"cycle"} and by[2, "p", "cycle"].errors == ["$: no JSON"]
    assert by[3, "x", "linked"].content is None and by[3, "x", "linked"].layer == 0
    assert sum(r.status == "duplicate" for r in got) == 2 and sum(r.status == "no id" for r in got) == 3
    assert by[1, "nobody", "orphan"].json is None


def test_turns_and_empty(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", None), (1, 3, "user", None), (None, 0, "user", "x"), (1, None, "user", "x")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in T.link(*T.from_turns(conversations), T.REPLY).collect()}
    assert got[1, "turn-1"].status == "linked" and got[1, "turn-3"].status == "missing" and not got[1, "turn-3"].valid
    assert T.link(*T.from_turns(conversations.limit(0)), T.REPLY).count() == 0


def test_canonical_json():
    assert T.canonical(T.parsed('{"b":[1.0,-0.0,1e20,1e21,1e-6,1.5e-7,0.1],"a":"\\u001f\\ud800é","\\ud83d\\ude00":1,"\\ufb33":true,"n":123456789012345678901}')) == (
        '{"a":"\\u001f\\ud800é","b":[1,0,100000000000000000000,1e+21,0.000001,1.5e-7,0.1],"n":123456789012345678901,"\U0001f600":1,"\ufb33":true}'
    )
    for bad in ("1e400", "NaN", "", None, "{", "-Infinity"):
        try:
            T.parsed(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert T.violations(1.0, {"type": "integer"}) == [] and T.violations(True, {"enum": [1]}) and T.violations(1, {"enum": [1.0]}) == []


def _depths(calls):
    """Longest chain below each call by repeated relaxation; None on or behind a cycle."""
    deps = {(c, i): {(c, d) for d in ds or () if d is not None} for c, _, _, i, _, _, ds, _ in calls}
    deps = {k: {d for d in ds if d in deps} for k, ds in deps.items()}
    out = {}
    for _ in deps:
        out |= {k: 1 + max((out[d] for d in ds), default=-1) for k, ds in deps.items() if all(d in out for d in ds)}
    return {k: out.get(k) for k in deps}


def test_layers_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    calls = []
    for conv in range(6):
        n = rng.randrange(20, 40)
        for i in range(n):
            deps = [f"c{rng.randrange(n if rng.random() < 0.02 else max(1, i))}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
            calls.append((conv, i, 0, f"c{i}", "add", "{}", [d for d in deps if d != f"c{i}" or rng.random() < 0.01] or None, "-"))
    calls += [(99, 0, 0, "s", "add", "{}", ["s"], "-"), (99, 1, 0, "behind", "add", "{}", ["s", None, "s"], "-")]
    calls += [(100, i, 0, f"c{i}", "add", "{}", [f"c{i + 1}"], "-") for i in range(300)]  # a long chain against the turns
    df = spark.createDataFrame(calls, CALLS)
    want = _depths(calls)
    assert None in want.values() and want[100, "c0"] == 299
    assert {(r.conv_id, r.call_id): r.layer for r in T.layers(df).collect()} == want


def test_surrogates_and_repeated_rows(spark):
    call = (1, 1, 0, "x", "add", '{"a":"\\ud800","\\udc00":1}', ["x\x1f"], "-")
    got = T.link(spark.createDataFrame([call, call], CALLS), spark.createDataFrame([(1, 2, "x", "\x1f" + "long " * 100_000, "-")] * 2, RESULTS), SCHEMAS).collect()
    assert sorted(r.status for r in got) == ["duplicate", "duplicate", "linked"]
    linked = next(r for r in got if r.status == "linked")
    assert linked.errors == ["$.a: not of type number", "$.?: unknown"] and linked.json.startswith('{"arguments":{"\\udc00":1,"a":"\\ud800"},"id":"x"') is False
    assert linked.arguments_json == '{"a":"\\ud800","\\udc00":1}' and '"result":"\\u001flong ' in linked.json and json.loads(linked.json)["id"] == "x"
