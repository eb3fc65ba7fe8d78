"""Tool-call linking: hash-join calls and results, order calls topologically, validate arguments, write canonical JSON.

Calls: conv_id, turn, pos, call_id, name, arguments (JSON text), depends_on (array of call ids of the conversation).
Results: conv_id, turn, call_id, content.

Order.  A call's layer is the length of the longest chain of calls that it depends on, so it is 0 for a call that needs
no other and ordering by layer is topological, whatever the turns say.  Calls that depend on one other form chains:
pointer jumping takes each to the end of its chain in as many rounds as the logarithm of the chain's length.  What is
left, calls with several dependencies and the ends of chains, is peeled: a round gives a layer to every such call whose
dependencies all have one, so rounds follow the number of joins of branches in a row, not the number of calls in a row.
What never gets a layer is on a cycle or behind one.  No conversation is ever gathered in one task, so one that holds a
third of all turns is dealt out by call id like any other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.scratch import table

_KEY = ["conv_id", "call_id"]


_LONE = re.compile("[\ud800-\udfff]")


def _number(value: int | float) -> str:
    """A number in the shortest form that ECMAScript writes; whole numbers have no fraction, integers keep all digits."""
    if isinstance(value, int):
        return str(value)
    if value == 0:
        return "0"
    digits = repr(value)
    if 1e-6 <= abs(value) < 1e21:
        plain = format(Decimal(digits), "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    head, _, power = digits.partition("e")
    return f"{head.removesuffix('.0')}e{int(power):+d}"


def canonical(value) -> str:
    """JSON as RFC 8785 asks: keys sorted by UTF-16 units, no optional white space, shortest numbers, only needed escapes.

    Lone surrogates, which that text refuses, are escaped; integers beyond 2**53 keep their digits.
    """
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, str):
        return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return _number(value)


def parsed(raw: str | None):
    """The value of a JSON text; ValueError for what is none, NaN, infinities and numbers too large for a double."""

    def refuse(text):
        raise ValueError(f"{text} is no JSON")

    def real(text):
        value = float(text)
        return value if abs(value) != float("inf") else refuse(text)

    return json.loads(raw or "", parse_constant=refuse, parse_float=real)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What is against ``schema``: type, enum, required, properties, additionalProperties, items, lengths and bounds."""
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: length {len(value)}")
    elif _is(value, "number") and (value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        out.append(f"{at}: out of bounds")
    return out


def validate(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` with arguments_json (canonical; null if no JSON), valid and errors.  Unknown names and bad JSON are invalid."""
    names = calls.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema) + ", arguments_json string, valid boolean, errors array<string>"
    name_at, arguments_at = names.index("name"), names.index("arguments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, valid, errors = [], [], []
            for name, raw in zip(batch.column(name_at).to_pylist(), batch.column(arguments_at).to_pylist(), strict=True):
                try:
                    value = parsed(raw)
                    text = canonical(value)
                except (ValueError, RecursionError):
                    texts.append(None)
                    found = ["$: no JSON"]
                else:
                    texts.append(text)
                    found = [_LONE.sub("?", x) for x in violations(value, schemas[name])] if name in schemas else ["unknown tool"]
                valid.append(not found)
                errors.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(valid), pa.array(errors, pa.list_(pa.string()))], names=[*names, "arguments_json", "valid", "errors"])

    return calls.mapInArrow(run, schema)


def layers(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, layer) of every call; layer is null on or behind a cycle.  Dependencies on unknown calls bind nothing."""
    nodes = table(calls.select(*_KEY, "depends_on"), "call_nodes")
    known = nodes.select("conv_id", F.col("call_id").alias("dep"))
    edges = nodes.select(*_KEY, F.explode("depends_on").alias("dep")).where("dep IS NOT NULL").distinct()
    edges = table(edges.join(known, ["conv_id", "dep"], "left_semi").select(*_KEY, "dep"), "call_edges")
    fan = edges.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("c"), F.min("dep").alias("to"))
    fan = table(fan, "fan")
    chained = table(_to_chain_ends(fan.where("c = 1").select(*_KEY, "to")), "chained")
    # Branching calls with their dependencies, each replaced by the end of its chain and the steps to it.
    ends = chained.select("conv_id", F.col("call_id").alias("dep"), "to", "steps", "ended")
    branches = edges.join(fan.where("c > 1").select(*_KEY), _KEY, "left_semi").join(ends, ["conv_id", "dep"], "left")
    branches = table(branches.select(*_KEY, F.coalesce("to", "dep").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.coalesce("ended", F.lit(True)).alias("ended")), "branches")
    layered = table(nodes.select(*_KEY).join(fan.select(*_KEY), _KEY, "left_anti").withColumn("layer", F.lit(0)), "layered")
    while not branches.isEmpty():
        at = layered.select("conv_id", F.col("call_id").alias("to"), "layer")
        ready = branches.join(at, ["conv_id", "to"], "left").groupBy(*_KEY).agg(F.bool_and(F.col("ended") & F.col("layer").isNotNull()).alias("ready"), F.max(F.col("layer") + F.col("steps")).cast("int").alias("layer"))
        ready = table(ready.where("ready").select(*_KEY, "layer"), "ready")
        if ready.isEmpty():
            break
        branches = table(branches.join(ready, _KEY, "left_anti"), "branches")
        layered = table(layered.union(ready), "layered")
    at = layered.select("conv_id", F.col("call_id").alias("to"), "layer")
    rest = chained.where("ended").join(at, ["conv_id", "to"]).select(*_KEY, (F.col("layer") + F.col("steps")).cast("int").alias("layer"))
    return nodes.select(*_KEY).join(layered.union(rest), _KEY, "left")


def _to_chain_ends(pointers: DataFrame) -> DataFrame:
    """pointers: conv_id, call_id, to.  Adds steps and ended: ``to`` is the first call met that has no pointer, after ``steps``."""
    at = table(pointers.withColumn("steps", F.lit(1)).withColumn("ended", F.lit(False)), "pointers")
    open_ = at.count()
    while open_:
        further = at.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("ended").alias("last"))
        jumped = at.where("not ended").join(further, ["conv_id", "to"], "left").select(
            *_KEY, F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("last", F.lit(True)).alias("ended")
        )
        at = table(at.where("ended").union(jumped.select(*at.columns)), "pointers")
        left = at.where("not ended").count()
        if left == open_:  # a round settles some call of every chain that has an end
            break
        open_ = left
    return at


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and one per result without call.

    conv_id, call_id, call_turn, pos, layer, name, arguments_json, valid, errors, result_turn, content, status, json.
    status is ``linked``, ``missing`` (no result), ``orphan`` (no call), ``duplicate`` (a later call or result of an id
    that an earlier one has), ``cycle`` (on or behind a cycle of dependencies) or ``no id`` (null conv_id or call_id).
    Ordering by (conv_id, layer, call_turn, pos) is topological.  json is the canonical form of a linked or missing
    call with its result.  Of calls with one id the first by (turn, pos, arguments) counts, of results the first by
    (turn, content).  Extra columns are ignored; empty tables give empty results; a very long text is one row's work.
    """
    calls = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("pos").cast("long").alias("pos"), "call_id", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    checked = table(validate(calls, schemas), "calls")
    known = checked.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    # A call id names few rows, so its window is small however long the conversation is.
    nth = F.row_number().over(Window.partitionBy(*_KEY).orderBy("turn", "pos", "arguments"))
    ranked = table(known.withColumn("nth", nth), "ranked_calls")
    first = ranked.where("nth = 1").drop("nth")
    answers = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select("conv_id", "call_id", F.col("turn").cast("long").alias("result_turn"), "content")
    answers = table(answers.withColumn("rn", F.row_number().over(Window.partitionBy(*_KEY).orderBy("result_turn", "content"))), "ranked_results")
    joined = first.withColumn("_c", F.lit(True)).join(answers.where("rn = 1").drop("rn").withColumn("_r", F.lit(True)), _KEY, "full")
    ordered = joined.join(layers(first), _KEY, "left")
    status = (
        F.when(F.col("_c").isNull(), "orphan").when(F.col("layer").isNull(), "cycle").when(F.col("_r").isNull(), "missing").otherwise("linked")
    )
    columns = [*_KEY, F.col("turn").alias("call_turn"), "pos", "layer", "name", "arguments_json", "valid", "errors", "result_turn", "content"]
    out = ordered.select(*columns, status.alias("status"))

    def rest(df: DataFrame, why: str, is_call: bool) -> DataFrame:
        null = lambda kind: F.lit(None).cast(kind)
        call = [F.col("turn"), F.col("pos"), null("int"), F.col("name"), F.col("arguments_json"), F.col("valid"), F.col("errors"), null("long"), null("string")]
        answer = [null("long"), null("long"), null("int"), null("string"), null("string"), null("boolean"), null("array<string>"), F.col("result_turn"), F.col("content")]
        return df.select(*_KEY, *(call if is_call else answer), F.lit(why))

    lost = results.where("conv_id IS NULL OR call_id IS NULL").select("conv_id", "call_id", F.col("turn").cast("long").alias("result_turn"), "content")
    out = (
        out.union(rest(ranked.where("nth > 1"), "duplicate", True))
        .union(rest(answers.where("rn > 1"), "duplicate", False))
        .union(rest(checked.where("conv_id IS NULL OR call_id IS NULL"), "no id", True))
        .union(rest(lost, "no id", False))
    )
    return _written(out)


def _written(rows: DataFrame) -> DataFrame:
    """Adds json, by the one writer of ``canonical``."""
    names = rows.columns
    places = [names.index(c) for c in ("status", "call_id", "name", "arguments_json", "content")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", json string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for status, call_id, name, arguments, content in zip(*(batch.column(i).to_pylist() for i in places), strict=True):
                if status not in ("linked", "missing"):
                    texts.append(None)
                    continue
                result = canonical(content if status == "linked" else None)
                texts.append(f'{{"arguments":{arguments or "null"},"id":{canonical(call_id)},"name":{canonical(name)},"result":{result}}}')
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "json"])

    return rows.mapInArrow(run, schema)


#: Schema of the calls that ``from_turns`` makes.
REPLY = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}}}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a table of plain turns: each user turn calls ``reply``, the assistant's next turn is its result.

    A call depends on the call two turns before it.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda t: F.format_string("turn-%d", t)
    arguments = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"prompt":'), F.coalesce(F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"), F.lit("null")), F.lit("}"))
    calls = turns.where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("pos"), F.when(F.col("turn").isNotNull(), name(F.col("turn"))).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", F.when(F.col("turn").isNotNull(), name(F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def query(spark, sf_dir: str) -> DataFrame:
    """Every call and result of the conversations' turns with its layer, status, errors and the digest of its JSON.

    Turns of other roles make neither calls nor results.  Null ids give rows of status ``no id``, repeated turns such of
    status ``duplicate``.
    """
    calls, results = from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = link(calls, results, REPLY)
    return out.select("conv_id", "call_id", "call_turn", "layer", "status", "valid", F.array_join("errors", "; ").alias("errors"), "result_turn", F.sha2("json", 256).alias("json_sha256"))


SQL = r"""
WITH RECURSIVE c0 AS (
  SELECT conv_id, turn, text, 'turn-' || turn AS call_id,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY '{"turn":' || turn || ',"prompt":' || coalesce(to_json(text)::VARCHAR, 'null') || '}') AS nth
  FROM conversations WHERE role = 'user'),
r0 AS (
  SELECT conv_id, turn, text, 'turn-' || (turn - 1) AS call_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) AS nth
  FROM conversations WHERE role = 'assistant'),
c AS (SELECT * FROM c0 WHERE nth = 1 AND conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT * FROM r0 WHERE nth = 1 AND conv_id IS NOT NULL AND turn IS NOT NULL),
deep AS (
  SELECT conv_id, turn, 0 AS layer FROM c WHERE turn < 2 OR NOT EXISTS (SELECT 1 FROM c AS o WHERE o.conv_id = c.conv_id AND o.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, layer + 1 FROM deep JOIN c ON c.conv_id = deep.conv_id AND c.turn = deep.turn + 2 WHERE c.turn >= 2),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS call_turn, r.turn AS result_turn,
         c.text AS prompt, r.text AS content, c.call_id IS NOT NULL AS has_call, r.call_id IS NOT NULL AS has_result
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
e AS (
  SELECT conv_id, call_id, call_turn, result_turn, prompt, content, has_call, has_result, CASE WHEN NOT has_call THEN 'orphan' WHEN has_result THEN 'linked' ELSE 'missing' END AS status FROM j
  UNION ALL SELECT conv_id, call_id, turn, NULL, text, NULL, true, false, CASE WHEN conv_id IS NULL OR turn IS NULL THEN 'no id' ELSE 'duplicate' END FROM c0 WHERE conv_id IS NULL OR turn IS NULL OR nth > 1
  UNION ALL SELECT conv_id, call_id, NULL, turn, NULL, text, false, true, CASE WHEN conv_id IS NULL OR turn IS NULL THEN 'no id' ELSE 'duplicate' END FROM r0 WHERE conv_id IS NULL OR turn IS NULL OR nth > 1)
SELECT e.conv_id, e.call_id, call_turn, CASE WHEN status IN ('linked', 'missing') THEN deep.layer END::INTEGER AS layer, status,
       CASE WHEN has_call THEN coalesce(length(prompt) BETWEEN 1 AND 400, false) AND call_turn IS NOT NULL END AS valid,
       CASE WHEN has_call THEN CASE WHEN call_turn IS NULL THEN '$: no JSON' WHEN prompt IS NULL THEN '$.prompt: not of type string'
                                    WHEN length(prompt) BETWEEN 1 AND 400 THEN '' ELSE '$.prompt: length ' || length(prompt) END END AS errors,
       result_turn,
       CASE WHEN status IN ('linked', 'missing') THEN sha256('{"arguments":{"prompt":' || coalesce(to_json(prompt)::VARCHAR, 'null') || ',"turn":' || call_turn || '},"id":"' || e.call_id || '","name":"reply","result":'
         || CASE WHEN has_result THEN coalesce(to_json(content)::VARCHAR, 'null') ELSE 'null' END || '}') END AS json_sha256
FROM e LEFT JOIN deep ON status IN ('linked', 'missing') AND deep.conv_id = e.conv_id AND deep.turn = call_turn
"""
