import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from mergestone.llm import tool_calls as T

SCHEMAS = {"add": {"properties": {"a": {"type": "integer", "least": 0, "most": 9}, "b": {"type": "number"}, "mode": {"type": "string", "enum": ["x", "y"]}}, "required": ["a"]}}


def test_problems():
    p = lambda a: T.problems(a, SCHEMAS["add"])
    assert p('{"a": 3, "b": 1.5, "mode": "x"}') == []
    assert p('{"b": true}') == ["b is not number", "missing a"]
    assert p('{"a": 10}') == ["a is out of range"] and p('{"a": "1"}') == ["a is not integer"]
    assert p('{"a": 1, "mode": "z", "q": 0}') == ["mode is not among the choices", "unexpected q"]
    assert p("[1]") == ["not an object"] and p("{") == p(None) == ["not JSON"] and T.problems("{}", None) == ["unknown tool"]


def test_canonical():
    assert T.canonical({"b": [1, {"z": "é", "a": None}], "a": 1.5}) == '{"a":1.5,"b":[1,{"a":null,"z":"é"}]}'


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from('[]{}":,\\ud8e9Na1-.') | st.characters(), max_size=30))
def test_any_arguments(text):
    T.problems(text, SCHEMAS["add"])
    try:
        out = T.canonical(T.parsed_json(text))
    except ValueError:
        return
    assert out.encode() and T.canonical(json.loads(out)) == out


def test_arguments_that_break_parsers():
    p = lambda a: T.problems(a, SCHEMAS["add"])
    for bad in ["[" * 100_000, '{"a":' * 100_000, '{"a": NaN}', '{"a": Infinity}', '{"a": 1, "b": 1e999}', '{"a": ' + "9" * 5000 + "}"]:
        assert p(bad) == ["not JSON"], bad[:20]
    assert p('{"a": 1, "mode": "\\ud800"}') == ["mode is not among the choices"] and p('{"a": 1, "\\udfff": 2}') == ["unexpected \ufffd"]
    assert T.canonical(json.loads('["\\ud800x", "\\ud83d\\ude00"]')) == '["\\ud800x","\U0001f600"]'


def test_lines_of_odd_arguments(spark):
    odd = ["[" * 100_000, '{"a": NaN}', '"\\ud800"', '{"b": "\\udc00"}', "\x00", ""]
    df = spark.createDataFrame([call(1, k, (f"c{k}", "add", a, None)) for k, a in enumerate(odd)], "conv_id long, turn long, role string, text string")
    got = T.link_tool_calls(df, SCHEMAS).orderBy("turn").collect()
    assert len(got) == len(odd) and not any(r.valid for r in got)
    assert [json.loads(r.line)["arguments"] for r in got] == [odd[0], odd[1], "\ud800", {"b": "\udc00"}, "\x00", ""]


def test_several_prerequisites(spark):
    rng = random.Random(4)
    after = {k: rng.sample(range(k), min(k, rng.choice([0, 1, 1, 1, 2, 3]))) for k in range(120)}
    after |= {200: [201, 5], 201: [200], 202: [999, 3], 203: [202], 204: [200, 202], 205: [119, 118, None], 206: [206, 1]}
    rows = []
    for c in (1, 2):
        rows += [call(c, rng.randrange(50), (f"k{k}", "add", "{}", [f"k{x}" if x is not None else None for x in xs] if len(xs) != 1 or k % 2 else f"k{xs[0]}")) for k, xs in after.items()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r.conv_id, r.call_id): r.depth for r in T.link_tool_calls(df, SCHEMAS).collect()}
    want = {}
    for k in [*range(120), 205]:
        want[k] = max([want[x] + 1 for x in after[k] if x is not None], default=0)
    assert got == {(c, f"k{k}"): want.get(k) for c in (1, 2) for k in after}


def call(conv, turn, *calls):
    return (conv, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "after": f} for i, n, a, f in calls]}))


def result(conv, turn, i, content):
    return (conv, turn, "tool", json.dumps({"tool_call_id": i, "content": content}))


def brute_depth(calls):
    after = {}
    for k, f in calls:
        after[k] = min([x for x in (after.get(k), f) if x is not None], default=None) if k in after else f
    out = {}
    for k in after:
        seen, at, n = {k}, k, 0
        while n is not None and after[at] is not None:
            at = (at[0], after[at])
            n = None if at in seen or at not in after else n + 1
            seen.add(at)
        out[k] = n
    return out


def test_link(spark):
    rows = [
        (1, 0, "user", "hi"), call(1, 1, ("a", "add", '{"a": 1}', None), ("b", "add", '{"a": 99}', "a")), result(1, 2, "a", "one"), result(1, 3, "b", "two"), result(1, 4, "a", "later"),
        call(1, 5, ("c", "sub", "{}", "b"), ("d", "add", "{", "nowhere")), result(1, 6, "zz", "alone"),
        call(2, 0, ("p", "add", '{"a": 2}', "q"), ("q", "add", '{"a": 2}', "p"), ("r", "add", '{"a": 2}', "p")), call(2, 1, ("s", "add", '{"a": 2}', "s")),
        call(3, 0, ("x", "add", '{"a": 1}', None)), call(3, 1, ("x", "add", '{"a": 2}', None)), result(3, 2, "x", "r"),
        (4, 0, "assistant", "no call"), (4, 1, "tool", "no json"), (4, 2, None, None), (None, 1, "tool", '{"tool_call_id": "a"}'), (4, None, "assistant", "{tool_calls broken"),
        *(call(5, k, (f"n{k}", "add", '{"a": 1}', f"n{k - 1}" if k else None)) for k in range(70)),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, status string").repartition(4)
    got = T.link_tool_calls(df, SCHEMAS).collect()
    by = {(r.conv_id, r.call_id, r.turn): r for r in got}
    assert (by[1, "a", 1].status, by[1, "a", 1].valid, json.loads(by[1, "a", 1].line)["result"]) == ("linked", True, {"turn": 2, "content": "one"})
    assert by[1, "b", 1].problems == "a is out of range" and by[1, "c", 5].problems == "unknown tool" and by[1, "d", 5].problems == "not JSON"
    assert (by[1, "zz", 6].status, by[1, "a", 4].status, by[1, "c", 5].status, by[3, "x", 0].status) == ("no_call", "repeated_result", "no_result", "repeated")
    calls = [((r.conv_id, r.call_id), json.loads(r.line)["after"]) for r in got if r.valid is not None]
    want = brute_depth(calls)
    assert all(r.depth == want[r.conv_id, r.call_id] for r in got if r.valid is not None) and by[5, "n69", 69].depth == 69
    assert len(got) == 80 + 2
    assert T.link_tool_calls(df.limit(0), SCHEMAS).count() == 0


def test_derived_calls(spark):
    chat = [(c, t, "system" if t == 0 and c == 2 else "user" if t % 2 == c % 2 else "assistant", "word " * (c * 7 + t * 3 + 1)) for c in range(1, 6) for t in range(7)] + [(9, 0, "user", None)]
    df = spark.createDataFrame(chat, "conv_id long, turn long, role string, text string").repartition(3)
    got = T.link_tool_calls(T.with_tool_calls(df), T.SCHEMAS).collect()
    users = {(c, t) for c, t, r, _ in chat if r == "user"}
    answers = {(c, t) for c, t, r, _ in chat if r == "assistant"}
    assert len(got) == len(users) + len([1 for c, t in answers if (c, t - 1) not in users])
    for r in got:
        x = json.loads(r.line)
        assert T.canonical(x) == r.line
        if r.valid is not None:
            t = (r.turn - 1) // 2
            depth = 0
            while (r.conv_id, t - 2 * depth - 2) in users:
                depth += 1
            assert r.depth == depth and (r.status == "linked") == ((r.conv_id, t + 1) in answers)
            text = dict(((c, k), v) for c, k, _, v in chat)[r.conv_id, t] or ""
            assert x["arguments"] == "{broken" or text in x["arguments"].values()


def test_arguments_of_any_depth(spark):
    chat = []
    for k, n in enumerate([1, 990, 1000, 1001, 1500, 5000, 9970, *range(9978, 9992), 20_000, 200_000]):
        arguments = '{"text":' + "[" * n + "]" * n + "}"
        chat.append((k, 1, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "translate", "arguments": arguments}]})))
    got = {r.conv_id: r for r in T.link_tool_calls(spark.createDataFrame(chat, "conv_id long, turn long, role string, text string"), T.SCHEMAS).collect()}
    assert len(got) == len(chat)
    assert isinstance(json.loads(got[0].line)["arguments"], dict) and isinstance(json.loads(got[3].line)["arguments"], str) and got[3].problems == "not JSON"


def test_what_a_call_waits_for_keeps_its_type(spark):
    call = lambda i, after: {"id": i, "name": "search", "arguments": '{"query":"x"}', "after": after}
    text = json.dumps({"tool_calls": [call("[a", None), call("b", "[a"), call("c", ["[a", "b"]), call("d", []), call("7", "d"), call("e", 7)]})
    got = {r.call_id: r for r in T.link_tool_calls(spark.createDataFrame([(1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"), T.SCHEMAS).collect()}
    assert {k: r.depth for k, r in got.items()} == {"[a": 0, "b": 1, "c": 2, "d": 0, "7": 1, "e": 2}
    assert json.loads(got["b"].line)["after"] == "[a"
