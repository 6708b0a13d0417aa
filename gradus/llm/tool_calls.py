"""Tool-call linking: calls joined to results, ordered, validated, as canonical JSON.

Calls and results meet by an equi-join on the call id.  A call may name the call it
follows; its level, the length of that chain, is found by pointer doubling: in each
round every call adds the distance of the call it points at and takes over its
pointer, so chains of length n take log2(n) equi-joins and no conversation is ever
gathered.  Ordering by level is a topological order.  A call whose chain does not end
is on, or leads to, a cycle.  Arguments are checked against a schema for each tool;
the record of a call is JSON with sorted keys, no spaces and unescaped Unicode.

``schemas`` is {tool: {field: (type, required)}}, types being string, integer,
number, boolean, array, object.

Defined cases: a call without id is dropped with its id unknown to all results; of
several calls (or results) of one id the smallest (first in order of all fields)
stands and ``n_calls`` (``n_results``) counts them; a missing parent counts as none,
with the error "parent missing"; a result without call has status "orphan"; null or
malformed arguments are errors, kept as the string they were; empty tables give
empty results.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

Schemas = dict[str, dict[str, tuple[str, bool]]]
_TYPES = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,)}
OUT = ("call_id string, parent_id string, name string, level int, status string, n_calls long, n_results long, "
       "errors array<string>, record string")


def _no_constant(name: str):
    raise ValueError(name)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def validate(name: str | None, arguments: str | None, schemas: Schemas) -> tuple[object, list[str]]:
    """Parsed arguments (the string itself if malformed) and the errors, sorted."""
    if name not in schemas:
        return arguments, ["unknown tool"]
    try:
        value = json.loads(arguments, parse_constant=_no_constant)
        canonical(value).encode()  # numbers out of range, lone surrogates
    except (TypeError, ValueError, RecursionError):
        return arguments, ["arguments are no JSON"]
    if not isinstance(value, dict):
        return value, ["arguments are no object"]
    schema, errors = schemas[name], []
    for field, (kind, required) in schema.items():
        if field not in value:
            if required:
                errors.append(f"missing {field}")
        elif not isinstance(value[field], _TYPES[kind]) or isinstance(value[field], bool) != (kind == "boolean"):
            errors.append(f"{field} is no {kind}")
    errors += [f"unexpected {field}" for field in value if field not in schema]
    return value, sorted(errors)


def _records(batches: Iterator[pa.RecordBatch], schemas: Schemas) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        errors, records = [], []
        for r in batch.to_pylist():
            if r["status"] == "orphan":
                value, found = None, []
            else:
                value, found = validate(r["name"], r["arguments"], schemas)
            if r["lost"]:
                found = sorted([*found, "parent missing"])
            if r["level"] is None and r["status"] != "orphan":
                found = sorted([*found, "cycle"])
            errors.append(found)
            records.append(canonical({"arguments": value, "errors": found, "id": r["call_id"], "level": r["level"],
                                      "name": r["name"], "parent": r["parent_id"], "result": r["content"],
                                      "status": r["status"]}))
        names = ["call_id", "parent_id", "name", "level", "status", "n_calls", "n_results"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(errors, pa.list_(pa.string())),
                                          pa.array(records, pa.string())], names=[*names, "errors", "record"])


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level of (call_id, parent_id), ids being distinct and parents present or
    null; level is null on and behind cycles."""
    state = stored(calls.select("call_id", F.col("parent_id").alias("to"),
                                F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("level")), "levels")
    for _ in range(max(1, math.ceil(math.log2(state.count() + 1)) + 1)):
        open_ = state.where("to is not null")
        if not open_.take(1):
            break
        ahead = state.select(F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        moved = open_.join(ahead, "to").select("call_id", F.col("next").alias("to"), (F.col("level") + F.col("more")).alias("level"))
        state = stored(state.where("to is null").unionByName(moved), "levels")
    return state.select("call_id", F.when(F.col("to").isNull(), F.col("level")).cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """A row for each call and each orphan result: see ``OUT``.  ``calls`` has call_id,
    parent_id, name, arguments; ``results`` has call_id, content."""
    c = (calls.where("call_id is not null").groupBy("call_id")
         .agg(F.min(F.struct("parent_id", "name", "arguments")).alias("c"), F.count("*").alias("n_calls"))
         .select("call_id", "c.parent_id", "c.name", "c.arguments", "n_calls"))
    c = stored(c, "calls")
    r = (results.where("call_id is not null").groupBy("call_id")
         .agg(F.min("content").alias("content"), F.count("*").alias("n_results")))
    known = c.select(F.col("call_id").alias("parent_id"), F.lit(True).alias("there"))
    c = c.join(known, "parent_id", "left").withColumn("lost", F.col("parent_id").isNotNull() & F.col("there").isNull())
    level = levels(c.select("call_id", F.when(F.col("there"), F.col("parent_id")).alias("parent_id")))
    both = (c.drop("there").join(level, "call_id").withColumn("called", F.lit(True)).join(r, "call_id", "full")
            .withColumn("status", F.when(F.col("called").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered")
                        .otherwise("answered"))
            .withColumns({"n_calls": F.coalesce("n_calls", F.lit(0)), "n_results": F.coalesce("n_results", F.lit(0)),
                          "lost": F.coalesce("lost", F.lit(False))}))
    return both.drop("called").mapInArrow(functools.partial(_records, schemas=schemas), OUT)


#: the registered query's tools: a conversation's user and system turns are calls
QUERY_SCHEMAS: Schemas = {"user": {"text": ("string", True), "turn": ("integer", True)},
                          "system": {"text": ("string", True), "turn": ("integer", True), "scope": ("string", False)}}


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of conversations: a user or system turn calls the
    tool of its name, an assistant's turn is the result of the turn before; a call
    follows the call before it, over an answer in between."""
    t = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                             "role", F.col("text").cast("string").alias("text"))
    name = lambda conv, turn: F.concat_ws(":", F.col(conv).cast("string"), turn.cast("string"))
    whole = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    answers = t.where(whole & (F.col("role") == "assistant"))
    before = answers.select("conv", (F.col("turn") + 1).alias("turn"), F.lit(1).alias("answered")).distinct()
    calls = t.where(whole & F.col("role").isin("user", "system")).join(before, ["conv", "turn"], "left")
    back = F.col("turn") - 1 - F.coalesce("answered", F.lit(0))
    return (calls.select(name("conv", F.col("turn")).alias("call_id"),
                         F.when(back >= 0, name("conv", back)).alias("parent_id"), F.col("role").alias("name"),
                         F.to_json(F.struct("text", "turn")).alias("arguments")),
            answers.select(name("conv", F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turns(read(spark, sf_dir, "conversations"))
    return (link(calls, results, QUERY_SCHEMAS)
            .select("call_id", "parent_id", "name", "level", "status", "n_calls", "n_results",
                    F.concat_ws(",", "errors").alias("errors"), "record"))


OP2_SQL = """
WITH RECURSIVE t AS (SELECT conv_id::BIGINT AS conv, turn::BIGINT AS turn, role, text FROM conversations
                     WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
a AS (SELECT DISTINCT conv, turn + 1 AS turn FROM t WHERE role = 'assistant'),
c0 AS (SELECT t.conv || ':' || t.turn AS call_id, t.turn, role AS name, text,
              CASE WHEN a.turn IS NULL THEN t.turn - 1 ELSE t.turn - 2 END AS back, t.conv
       FROM t LEFT JOIN a ON a.conv = t.conv AND a.turn = t.turn WHERE role IN ('user', 'system')),
c AS (SELECT call_id, CASE WHEN back >= 0 THEN conv || ':' || back END AS parent_id, name, turn,
             min(text) AS text, count(*) AS n_calls FROM c0 GROUP BY ALL),
r AS (SELECT conv || ':' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
      FROM t WHERE role = 'assistant' GROUP BY 1),
p AS (SELECT c.*, CASE WHEN parent_id IN (SELECT call_id FROM c) THEN parent_id END AS link FROM c),
lv AS (SELECT call_id, 0 AS level FROM p WHERE link IS NULL
       UNION ALL SELECT p.call_id, lv.level + 1 FROM p JOIN lv ON p.link = lv.call_id),
j AS (SELECT coalesce(p.call_id, r.call_id) AS call_id, parent_id, name, level, coalesce(n_calls, 0) AS n_calls,
             coalesce(n_results, 0) AS n_results, content, turn, text,
             CASE WHEN p.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
             concat_ws(',', CASE WHEN p.call_id IS NOT NULL AND text IS NULL THEN 'missing text' END,
                       CASE WHEN parent_id IS NOT NULL AND link IS NULL THEN 'parent missing' END) AS errors
      FROM p LEFT JOIN lv USING (call_id) FULL JOIN r ON r.call_id = p.call_id)
SELECT call_id, parent_id, name, level, status, n_calls, n_results, errors,
       '{"arguments":' || CASE WHEN status = 'orphan' THEN 'null' WHEN text IS NULL THEN '{"turn":' || turn || '}'
                               ELSE '{"text":' || to_json(text) || ',"turn":' || turn || '}' END
       || ',"errors":' || CASE WHEN errors = '' THEN '[]' ELSE to_json(string_split(errors, ',')) END
       || ',"id":' || to_json(call_id) || ',"level":' || coalesce(level::VARCHAR, 'null')
       || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null')
       || ',"parent":' || coalesce(to_json(parent_id)::VARCHAR, 'null')
       || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null')
       || ',"status":' || to_json(status) || '}' AS record
FROM j
"""
