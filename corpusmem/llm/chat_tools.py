"""Chat formatting: tool calls linked to results, ordered, validated and serialised as canonical JSON."""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The argument schemas that the query's derived calls are held against.
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 150}, "limit": {"type": "integer", "minimum": 0, "maximum": 50}}},
    "answer": {"type": "object", "required": ["question"], "additionalProperties": False, "properties": {"question": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 1}}},
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no white space and characters as they are: equal values give equal strings."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(content: str | None):
    """(arguments, True), or (content, False) where it isn't JSON, nests too deeply, or holds what JSON text can't say.

    NaN and infinities, numbers beyond a double's range and lone surrogates are such; the content then stays as text.
    """
    try:
        value = json.loads(content or "", parse_constant=_no_constant)
        json.dumps(value, ensure_ascii=False, allow_nan=False).encode("utf-8")
        return value, True
    except (ValueError, RecursionError):  # UnicodeEncodeError is a ValueError
        return content, False


def valid(value, schema: dict) -> bool:
    """Whether a value meets a schema (type, enum, required, properties, additionalProperties, items, lengths, bounds)."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, int if kind == "integer" else (int, float)):
            return False
    elif kind is not None and not isinstance(value, _TYPES[kind]):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())):
            return False
        if schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(valid(v, known[k]) for k, v in value.items() if k in known)
    if isinstance(value, list):
        return all(valid(v, schema["items"]) for v in value) if "items" in schema else True
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    return True


def topological(ids: list[str], after: list[list[str]]) -> list[int]:
    """Places in an order that puts each call after those it depends on, otherwise in the given order.

    Unknown and own ids are ignored; calls on a cycle follow at the end in the given order. Of repeated ids the first
    is the one depended on.
    """
    place = {}
    for i, x in enumerate(ids):
        place.setdefault(x, i)
    needs = [{place[x] for x in set(a or ()) if x in place and place[x] != i} for i, a in enumerate(after)]
    users: list[list[int]] = [[] for _ in ids]
    for i, n in enumerate(needs):
        for x in n:
            users[x].append(i)
    left = [len(n) for n in needs]
    ready = [i for i, n in enumerate(left) if n == 0]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)
        out.append(i)
        for u in users[i]:
            left[u] -= 1
            if left[u] == 0:
                heapq.heappush(ready, u)
    done = set(out)
    return out + [i for i in range(len(ids)) if i not in done]


def calls_of_turns(conversations: DataFrame) -> DataFrame:
    """Messages with tool calls derived from plain turns: (conv_id, turn, role, kind, call_id, name, content, after).

    A user turn is a call of `search` (even conv_id) or `answer` (odd), with the text as argument, that depends on the
    call two turns before; an assistant turn is the result of the call one turn before; other turns are messages.
    """
    text, turn = F.coalesce(F.col("text"), F.lit("")), F.col("turn")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    ident = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (turn - back).cast("string"))
    even = F.col("conv_id") % 2 == 0
    args = F.when(even, F.to_json(F.struct(text.alias("query"), turn.cast("long").alias("limit")))).otherwise(F.to_json(F.struct(text.alias("question"), turn.cast("long").alias("turn"))))
    return conversations.select(
        "conv_id", "turn", "role",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user, ident(0)).when(assistant, ident(1)).alias("call_id"),
        F.when(user, F.when(even, "search").otherwise("answer")).alias("name"),
        F.when(user, args).otherwise(text).alias("content"),
        F.when(user, F.array(ident(2))).alias("after"),
    )


_COLUMNS = ("conv_id", "turn", "role", "kind", "call_id", "name", "content", "after")


def format_chats(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, n_calls, n_linked, n_valid, n_loose, chat): one canonical JSON string for each conversation.

    Calls meet results in a hash join by (conversation, identifier): the first result by turn answers the first call by
    turn; other calls stay without a result, other results and results without a call count as loose and are not in the
    chat. Calls stand in topological order of `after`, then plain messages are merged in by turn. Arguments are parsed
    and held against the schema of the call's name; unknown names, malformed or null arguments (see parse) are invalid and
    kept as text. A row with a null conversation id is a conversation of its own, so such rows never meet in one task;
    null turns come first; repeated rows are kept; an empty table gives an empty one; other columns are not read. A
    conversation's calls and messages meet in one task, as they do in its output row.
    """
    messages = messages.select(*_COLUMNS, F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(0).alias("alone"))
    first = W.partitionBy("conv_id", "alone", "call_id").orderBy(F.col("turn").asc_nulls_first(), F.col("content").asc_nulls_first())
    calls = messages.where("kind = 'call'").withColumn("nth", F.row_number().over(first))
    results = messages.where("kind = 'result'").withColumn("nth", F.row_number().over(first))
    answer = results.where("nth = 1 and conv_id is not null").select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.lit(1).alias("one"), F.struct("content").alias("result"))
    on = (calls["conv_id"] == F.col("c")) & (calls["call_id"] == F.col("i")) & (calls["nth"] == F.col("one"))
    linked = calls.join(answer.hint("shuffle_hash"), on, "left").select("conv_id", "turn", "role", "kind", "call_id", "name", "content", "after", "alone", "result")
    others = messages.where("kind <> 'call' or kind is null").withColumn("result", F.lit(None).cast("struct<content:string>"))
    rows = linked.unionByName(others.select(linked.columns))
    kind = messages.schema["conv_id"].dataType.simpleString()

    def chat(key, table):
        rows = table.to_pylist()
        order = lambda r: (r["turn"] is not None, r["turn"] or 0, r["content"] or "")
        calls = sorted((r for r in rows if r["kind"] == "call"), key=order)
        calls = [calls[i] for i in topological([r["call_id"] for r in calls], [r["after"] for r in calls])]
        out, n_valid = [], 0
        for r in calls:
            args, ok = parse(r["content"])
            ok = ok and r["name"] in schemas and valid(args, schemas[r["name"]])
            n_valid += ok
            item = {"arguments": args, "id": r["call_id"], "name": r["name"], "turn": r["turn"], "valid": ok}
            out.append(item | ({"result": r["result"]["content"]} if r["result"] else {}))
        plain = sorted((r for r in rows if r["kind"] not in ("call", "result")), key=order)
        merged, k = [], 0
        for item in out:  # before a call come the messages of earlier or equal turns
            while k < len(plain) and (plain[k]["turn"] is None or (item["turn"] is not None and plain[k]["turn"] <= item["turn"])):
                merged.append({"content": plain[k]["content"], "role": plain[k]["role"], "turn": plain[k]["turn"]})
                k += 1
            merged.append(item)
        merged += [{"content": r["content"], "role": r["role"], "turn": r["turn"]} for r in plain[k:]]
        n_linked = sum("result" in x for x in out)
        text = canonical({"conversation": key[0].as_py(), "items": merged})
        n = [len(calls), n_linked, n_valid, sum(r["kind"] == "result" for r in rows) - n_linked]
        return pa.table([pa.array([key[0].as_py()], table.schema.field("conv_id").type), *[pa.array([x], pa.int64()) for x in n], pa.array([text])], ["conv_id", "n_calls", "n_linked", "n_valid", "n_loose", "chat"])

    return rows.groupBy("conv_id", "alone").applyInArrow(chat, f"conv_id {kind}, n_calls long, n_linked long, n_valid long, n_loose long, chat string")


def digest(chats: DataFrame) -> DataFrame:
    """The chat's length and hash beside the counts."""
    return chats.withColumn("n_chars", F.length("chat").cast("long")).withColumn("chat_sha256", F.sha2(F.col("chat").cast("binary"), 256)).drop("chat")


ORACLE = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT u.*, a.text AS result, a.conv_id IS NOT NULL AS linked,
             CASE WHEN u.conv_id % 2 = 0 THEN length(u.text) BETWEEN 1 AND 150 AND u.turn BETWEEN 0 AND 50 ELSE length(u.text) >= 1 AND u.turn >= 1 END AS ok
      FROM m u LEFT JOIN m a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
i AS (SELECT conv_id, turn, 1 AS k, '{"arguments":{' || CASE WHEN conv_id % 2 = 0 THEN '"limit":' || turn || ',"query":' || to_json(text) ELSE '"question":' || to_json(text) || ',"turn":' || turn END || '},"id":"' || conv_id || ':' || turn
        || '","name":"' || CASE WHEN conv_id % 2 = 0 THEN 'search' ELSE 'answer' END || '",' || CASE WHEN linked THEN '"result":' || to_json(result) || ',' ELSE '' END || '"turn":' || turn || ',"valid":' || CASE WHEN ok THEN 'true' ELSE 'false' END || '}' AS j FROM c
      UNION ALL SELECT conv_id, turn, 0, '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"turn":' || turn || '}' FROM m WHERE role NOT IN ('user', 'assistant')),
s AS (SELECT conv_id, string_agg(j, ',' ORDER BY turn, k) AS j FROM i GROUP BY conv_id),
n AS (SELECT conv_id, count(*) AS n_calls, count(*) FILTER (WHERE linked) AS n_linked, count(*) FILTER (WHERE ok) AS n_valid FROM c GROUP BY conv_id),
g AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS n_results FROM m GROUP BY conv_id),
f AS (SELECT conv_id, coalesce(n_calls, 0) AS n_calls, coalesce(n_linked, 0) AS n_linked, coalesce(n_valid, 0) AS n_valid, n_results - coalesce(n_linked, 0) AS n_loose,
             '{"conversation":' || conv_id || ',"items":[' || coalesce(j, '') || ']}' AS chat FROM g LEFT JOIN n USING (conv_id) LEFT JOIN s USING (conv_id))
SELECT conv_id, n_calls, n_linked, n_valid, n_loose, CAST(length(chat) AS BIGINT) AS n_chars, sha256(chat) AS chat_sha256 FROM f
"""
