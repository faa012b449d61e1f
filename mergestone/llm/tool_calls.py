"""Chat formatting: links tool calls to their results, orders calls, validates arguments, and writes canonical JSON.

A chat is a table (conv_id, turn, role, text). An assistant's text may be JSON with ``tool_calls``: a list of {id, name,
arguments, after}, ``after`` being the id of the call whose result it needs, or a list of such ids. A tool's text is JSON with
``tool_call_id`` and ``content``. Calls and results are hash-joined by (conv_id, identifier). A call's place in topological order
is its depth, the length of the longest chain of calls it waits for. Stretches in which every call waits for one other are found
by pointer doubling: each round joins every call with the call its pointer has reached, so a chain of n calls takes log2 n
rounds; calls that wait for several are settled round by round, as soon as all they wait for are, which takes as many rounds as
there are such calls behind one another. No conversation is gathered in one task. Calls in a cycle, or that wait for a call that
does not exist, have no depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergestone.llm.shared import dropped, written

CALLS = "tool_calls array<struct<id: string, name: string, arguments: string, after: variant>>"
LONE = re.compile(r"[\ud800-\udfff]")
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def canonical(value) -> str:
    """Keys in order of code points, no white space, characters as they are, but for halves of surrogate pairs, which are
    escaped. Infinities and what is not a number are no JSON: ValueError."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


#: Levels of lists and objects that arguments may have; the parser and the writer of JSON manage several times as many.
DEEPEST = 1000


def parsed_json(text: str | None):
    """The value of a JSON text that :func:`canonical` can write again, inside other objects too; else ValueError: for one of more than
    :data:`DEEPEST` levels, or with numbers that no double holds, too."""
    try:
        value = json.loads(text or "")
    except RecursionError:
        raise ValueError("nested too deep") from None
    level, inside = 0, [value]
    while inside := [y for x in inside if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]:
        level += 1
        if level > DEEPEST:
            raise ValueError("nested too deep")
    canonical(value)
    return value


def problems(arguments: str | None, schema: dict | None) -> list[str]:
    """What keeps arguments from fitting a schema of {properties, required, additional}; an empty list if they fit."""
    if schema is None:
        return ["unknown tool"]
    try:
        given = parsed_json(arguments)
    except ValueError:
        return ["not JSON"]
    if not isinstance(given, dict):
        return ["not an object"]
    out = [f"missing {k}" for k in schema.get("required", []) if k not in given]
    for k, v in given.items():
        rule = schema["properties"].get(k)
        if rule is None:
            if not schema.get("additional", False):
                out.append(f"unexpected {k}")
            continue
        kind = TYPES[rule["type"]]
        if not isinstance(v, kind) or isinstance(v, bool) and rule["type"] != "boolean":
            out.append(f"{k} is not {rule['type']}")
        elif "enum" in rule and v not in rule["enum"]:
            out.append(f"{k} is not among the choices")
        elif isinstance(v, str) and len(v) < rule.get("least", 0) or not isinstance(v, (str, list, dict, bool)) and not rule.get("least", float("-inf")) <= v <= rule.get("most", float("inf")):
            out.append(f"{k} is out of range")
    return [LONE.sub("\N{REPLACEMENT CHARACTER}", x) for x in sorted(out)]


def parsed(chat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a chat. Text that is no such JSON is neither."""
    rows = chat.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    calls = rows.filter("role = 'assistant' and text like '{%tool_calls%'").select("conv_id", "turn", F.posexplode(F.from_json("text", CALLS)["tool_calls"]).alias("place", "call"))
    after = F.col("call.after")  # one identifier, or an array of them
    needed = F.when(F.schema_of_variant(after).startswith("ARRAY"), F.try_variant_get(after, "$", "array<string>")).when(after.isNotNull(), F.array(F.try_variant_get(after, "$", "string")))
    needed = F.array_sort(F.array_distinct(F.filter(F.coalesce(needed, F.array().cast("array<string>")), lambda x: x.isNotNull())))
    calls = calls.select("conv_id", "turn", "place", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"), needed.alias("after"))
    results = rows.filter("role = 'tool' and text like '{%'").withColumn("r", F.from_json("text", "tool_call_id string, content string"))
    return calls.filter("call_id is not null"), results.select("conv_id", F.col("turn").alias("result_turn"), F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content")).filter("call_id is not null")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) from (conv_id, call_id, after), after being an array; several calls of one identifier wait for
    all that each of them waits for. depth is null in a cycle or behind a call that does not exist."""
    known = calls.select("conv_id", "call_id").distinct()
    waits = calls.select("conv_id", "call_id", F.explode("after").alias("to")).distinct()
    there = known.withColumnRenamed("call_id", "to").withColumn("there", F.lit(True))
    waits = written(waits.join(there, ["conv_id", "to"], "left"), "waits")
    number = waits.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("to").alias("to"), F.count("there").alias("there"))
    # to: the call reached so far; done: it waits for none or several, so the pointer stays; steps: calls passed; null: no way
    single = F.col("n") == 1
    at = known.join(number, ["conv_id", "call_id"], "left").select(
        "conv_id", "call_id", F.when(single, F.col("to")).otherwise(F.col("call_id")).alias("to"),
        F.when(F.col("n") > F.col("there"), None).otherwise(F.when(single, 1).otherwise(0)).cast("long").alias("steps"), (~F.coalesce(single & (F.col("n") == F.col("there")), F.lit(False))).alias("done"),
    )
    at = written(at, "depths")
    rounds, n = 0, at.count()
    while (1 << rounds) <= n and not at.filter("not done").isEmpty():
        ahead = at.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("done").alias("over"))
        step = at.join(ahead, ["conv_id", "to"], "left")
        on = ~F.col("done") & F.col("over").isNotNull()
        step = step.select("conv_id", "call_id", F.when(on, F.col("next")).otherwise(F.col("to")).alias("to"), F.when(on, F.col("steps") + F.col("more")).otherwise(F.col("steps")).alias("steps"), F.when(on, F.col("over")).otherwise(F.col("done")).alias("done"))
        new = written(step, "depths")
        dropped(at)
        at, rounds = new, rounds + 1
    at = at.withColumn("steps", F.when(F.col("done"), F.col("steps")))
    several = number.filter("n > 1").select("conv_id", "call_id")
    starts = known.join(number, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).cast("long").alias("depth"))
    settled = starts
    if not several.isEmpty():
        reach = at.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("from"), "steps")
        edges = written(waits.join(several, ["conv_id", "call_id"], "left_semi").join(reach, ["conv_id", "to"], "left").select("conv_id", "call_id", "from", (F.col("steps") + 1).alias("steps")), "edges")
        # an edge leaves when its end is settled, and leaves the greatest depth so far behind; with its last edge a call is settled
        new, left, got, name = written(starts, "settled"), edges, None, ["conv_id", "call_id"]
        rounds = [new]
        while not new.isEmpty():
            hit = written(left.join(new.withColumnRenamed("call_id", "from"), ["conv_id", "from"]).withColumn("depth", F.col("depth") + F.col("steps")), "hit")
            rest = written(left.join(hit, ["conv_id", "call_id", "from"], "left_anti"), "edges")
            seen = hit.select(*name, "depth")
            seen = (seen if got is None else got.unionByName(seen)).groupBy(*name).agg(F.max("depth").alias("depth"))
            open_calls = rest.select(*name).distinct().withColumn("open", F.lit(True))
            both = written(seen.join(open_calls, name, "left"), "seen")
            for table in (left, hit):
                dropped(table)
            new, got, left = both.filter("open is null").drop("open"), both.filter("open").drop("open"), rest
            rounds.append(new)
        while len(rounds) > 1:  # a flat table of all rounds, put together in a tree
            rounds = [written(reduce(DataFrame.unionByName, rounds[k : k + 32]), "settled") for k in range(0, len(rounds), 32)]
        settled = rounds[0]
    ends = settled.select("conv_id", F.col("call_id").alias("to"), "depth")
    return at.join(ends, ["conv_id", "to"], "left").select("conv_id", "call_id", (F.col("depth") + F.col("steps")).alias("depth"))


def link_tool_calls(chat: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call and for each result without a call: (conv_id, turn, place, call_id, status, depth, valid,
    problems, line).

    status is linked, no_result, no_call, or repeated (the identifier has several calls; each is linked to the first result).
    Of several results of an identifier the earliest counts, and of those of one turn the least content; the others are
    repeated_result. line is the canonical JSON of call and result. Rows with a null conv_id or identifier are left out; null or
    other texts, empty tables and extra columns make no difference; texts of any length are read whole. Arguments that are no JSON,
    have more than 1,000 levels, or hold numbers that no double holds, are not valid and stand in line as a string. Ordered by (conv_id, depth, turn, place), each call comes
    after all that it waits for.
    """
    calls, results = parsed(chat)
    calls, results = written(calls.filter("conv_id is not null"), "calls"), written(results.filter("conv_id is not null"), "results")
    best = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("result_turn", "content")).alias("r"), F.count("*").alias("n_results"))
    many = calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_calls"))
    linked = calls.join(best, ["conv_id", "call_id"], "left").join(many, ["conv_id", "call_id"]).join(depths(calls), ["conv_id", "call_id"], "left")
    status = F.when(F.col("n_calls") > 1, "repeated").when(F.col("r").isNull(), "no_result").otherwise("linked")
    linked = linked.select("conv_id", "turn", "place", "call_id", status.alias("status"), "depth", "name", "arguments", "after", F.col("r.result_turn").alias("result_turn"), F.col("r.content").alias("content"))
    left = results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("status", F.lit("no_call"))
    extra = results.join(best.filter("n_results > 1"), ["conv_id", "call_id"]).filter("not (struct(result_turn, content) <=> r)").join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_semi")
    alone = left.select("conv_id", "call_id", "result_turn", "content", "status").unionByName(extra.select("conv_id", "call_id", "result_turn", "content", F.lit("repeated_result").alias("status")))
    none = lambda kind: F.lit(None).cast(kind)
    alone = alone.select("conv_id", F.col("result_turn").alias("turn"), none("int").alias("place"), "call_id", "status", none("long").alias("depth"), none("string").alias("name"), none("string").alias("arguments"), none("array<string>").alias("after"), "result_turn", "content")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, said, lines = [], [], []
            for x in batch.to_pylist():
                out = {"conv_id": x["conv_id"], "id": x["call_id"], "status": x["status"]}
                wrong = None
                if x["status"] not in ("no_call", "repeated_result"):
                    wrong = problems(x["arguments"], schemas.get(x["name"]))
                    try:
                        given = parsed_json(x["arguments"])
                    except ValueError:
                        given = x["arguments"]
                    out |= {"name": x["name"], "arguments": given, "after": (x["after"] or [None])[0] if len(x["after"] or []) < 2 else x["after"], "depth": x["depth"], "turn": x["turn"]}
                if x["result_turn"] is not None:
                    out["result"] = {"turn": x["result_turn"], "content": x["content"]}
                valid.append(None if wrong is None else not wrong)
                said.append(None if wrong is None else "; ".join(wrong))
                lines.append(canonical(out))
            keep = ["conv_id", "turn", "place", "call_id", "status", "depth"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(valid, pa.bool_()), pa.array(said, pa.string()), pa.array(lines, pa.string())], [*keep, "valid", "problems", "line"])

    return linked.unionByName(alone).mapInArrow(write, "conv_id long, turn long, place int, call_id string, status string, depth long, valid boolean, problems string, line string")


# ----------------------------------------------------------------------------------- calls that a plain chat gives rise to

#: Tools that the derived calls use.
SCHEMAS = {
    "search": {"properties": {"query": {"type": "string", "least": 1}, "limit": {"type": "integer", "least": 1, "most": 50}}, "required": ["query"]},
    "count": {"properties": {"text": {"type": "string"}, "unit": {"type": "string", "enum": ["words", "lines"]}}, "required": ["text", "unit"]},
    "translate": {"properties": {"text": {"type": "string"}, "to": {"type": "string"}}, "required": ["text", "to"], "additional": True},
}


def with_tool_calls(chat: DataFrame) -> DataFrame:
    """A chat in which each user turn is followed by an assistant's call on its whole text, and each assistant turn is the
    tool's result of the call of the turn before. A call waits for the call of the user turn two before, if that is one, and a
    search for that of the user turn four before, too.

    Tool and arguments follow from the text by rule (its length mod 3; limits and units that do not fit the schema for some
    lengths), so that all outcomes occur. System turns stay; turn numbers are doubled.
    """
    rows = chat.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), turn)
    users = rows.filter("role = 'user' and conv_id is not null and turn is not null")
    before = lambda k: users.select("conv_id", (F.col("turn") + k).alias("turn")).distinct().withColumn(f"waits_{k}", F.lit(True))
    size = F.length("text")
    search = F.to_json(F.struct(F.col("text").alias("query"), (size % 60).cast("int").alias("limit")))
    count = F.to_json(F.struct(F.col("text"), F.when(size % 5 == 0, "pages").when(size % 2 == 0, "words").otherwise("lines").alias("unit")))
    translate = F.when(size % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("text"), F.lit("en").alias("to"), size.alias("n"))))
    tool = F.when(size % 3 == 0, "search").when(size % 3 == 1, "count").otherwise("translate")
    arguments = F.when(size % 3 == 0, search).when(size % 3 == 1, count).otherwise(translate)
    after = F.array(F.when(F.col("waits_2"), name(F.col("turn") - 2)), F.when(F.col("waits_4") & (size % 3 == 0), name(F.col("turn") - 4)))
    call = F.struct(name(F.col("turn")).alias("id"), tool.alias("name"), arguments.alias("arguments"), F.filter(after, lambda x: x.isNotNull()).alias("after"))
    made = users.join(before(2), ["conv_id", "turn"], "left").join(before(4), ["conv_id", "turn"], "left").select("conv_id", (F.col("turn") * 2 + 1).alias("turn"), F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    result = F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    answers = F.col("role") == "assistant"
    kept = rows.select("conv_id", (F.col("turn") * 2).alias("turn"), F.when(answers, "tool").otherwise(F.col("role")).alias("role"), F.when(answers, result).otherwise(F.col("text")).alias("text"))
    return kept.unionByName(made)
