"""Tool-call linking, in DataFrame functions alone.

Calls and results meet in hash joins by identifier. Calls are ordered topologically: a call comes after all that it builds on
(its parents), at the length of the longest chain of calls that leads to it. Chains of calls with one parent each are
followed by pointer doubling, in as many rounds as their length's logarithm; only calls with several parents, where chains
meet, are peeled layer by layer. Arguments are validated against a schema compiled to column expressions, and each linked
call is written as canonical JSON (keys sorted at every level, no white space).

A parent of very many calls is no task's whole work: rows that look for it meet a broadcast of such parents (join_stats).
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import HOT_ROWS
from marlstone.operators.graph import longest_chains

_TYPES = {"string": "string", "integer": "long", "number": "double", "boolean": "boolean"}


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no white space; null where it can't be parsed."""
    return F.to_json(F.try_parse_json(json))


def violations(json: Column, schema: Mapping[str, Any]) -> Column:
    """Sorted array of what the arguments break: <name>:<rule>, or :object where they are no JSON object.

    schema: properties with type, minLength, maxLength, pattern, minimum, maximum and enum; required; additionalProperties.
    A property that is null counts as missing.
    """
    value = F.try_parse_json(json)
    shape = F.schema_of_variant(value)
    is_object = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    found: list[Column] = []
    required = schema.get("required", [])
    for name, rules in schema.get("properties", {}).items():
        path = f"$['{name}']"
        raw = F.try_variant_get(value, path, "variant")
        kind = F.schema_of_variant(raw)
        there = raw.isNotNull() & (kind != "VOID")
        got = F.try_variant_get(value, path, _TYPES[rules.get("type", "string")])
        right = {"string": kind == "STRING", "integer": kind == "BIGINT", "number": (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), "boolean": kind == "BOOLEAN"}[rules.get("type", "string")]
        if name in required:
            found.append(F.when(~F.coalesce(there, F.lit(False)), F.lit(f"{name}:required")))
        found.append(F.when(there & ~right, F.lit(f"{name}:type")))
        tests = {
            "minLength": lambda n, got=got: F.length(got) < n,
            "maxLength": lambda n, got=got: F.length(got) > n,
            "pattern": lambda p, got=got: ~got.rlike(p),
            "minimum": lambda n, got=got: got < n,
            "maximum": lambda n, got=got: got > n,
            "enum": lambda xs, got=got: ~got.isin(list(xs)),
        }
        found += [F.when(there & right & tests[rule](limit), F.lit(f"{name}:{rule}")) for rule, limit in rules.items() if rule in tests]
    if schema.get("additionalProperties", True) is False:
        extra = F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>"))
        found.append(F.when(F.size(extra) > 0, F.lit(":additionalProperties")))
    inside = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return F.array_sort(F.when(is_object, inside).otherwise(F.array(F.lit(":object"))))


def positions(calls: DataFrame, id_col: str = "call_id", parents_col: str = "parent_ids", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id_col, position): the length of the longest chain of calls that a call builds on. parents_col: an array of identifiers.

    Null in or after a cycle. A parent that isn't there is none, and so is a null one; a call that is its own parent is a cycle.
    Rows that repeat an identifier add up their parents.
    """
    ids = calls.select(F.col(id_col).alias("id")).filter("id IS NOT NULL")
    edges = calls.select(F.col(id_col).alias("id"), F.explode(parents_col).alias("up")).filter("id IS NOT NULL AND up IS NOT NULL")
    return longest_chains(ids, edges, hot_rows).select(F.col("id").alias(id_col), "position")


def link(calls: DataFrame, results: DataFrame, schema: Mapping[str, Any], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each identifier of calls (call_id, parent_ids, name, arguments) and results (call_id, content).

    Columns: call_id, position, is_call, answered, n_violations, violations (comma-joined), record (canonical JSON of
    arguments, id, name and result; arguments that can't be parsed are null there), n_copies, n_calls, n_results. Calls or
    results that repeat an identifier collapse to the least: n_copies counts the calls, n_calls and n_results the different
    ones, so that more than 1 tells of a conflict. Rows without an identifier are dropped, as nothing can be linked to
    them. A result without a call has is_call false and a null position. Other columns are not read.
    """
    # copies are counted away first, so that an identifier of very many rows meets itself only after that
    parents = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("parent_ids", F.array().cast("array<string>")))))
    each_call = calls.filter(F.col("call_id").isNotNull()).select("call_id", "name", "arguments", parents.alias("parent_ids")).groupBy("call_id", "name", "arguments", "parent_ids").agg(F.count("*").alias("n"))
    one_call = each_call.groupBy("call_id").agg(F.min(F.struct("name", "arguments", "parent_ids")).alias("c"), F.sum("n").alias("n_copies"), F.count("*").alias("n_calls"))
    each_result = results.filter(F.col("call_id").isNotNull()).select("call_id", "content").distinct()
    one_result = each_result.groupBy("call_id").agg(F.min(F.struct(F.col("content").isNull().alias("none"), F.col("content"))).alias("r"), F.count("*").alias("n_results"))
    ranks = positions(one_call.select("call_id", F.col("c.parent_ids").alias("parent_ids")), hot_rows=hot_rows)
    met = one_call.join(ranks.hint("shuffle_hash"), "call_id").join(one_result.hint("shuffle_hash"), "call_id", "full_outer")
    broken = violations(F.col("c.arguments"), schema)
    record = F.to_json(F.struct(F.try_parse_json(F.col("c.arguments")).alias("arguments"), F.col("call_id").alias("id"), F.col("c.name").alias("name"), F.col("r.content").alias("result")), {"ignoreNullFields": "false"})
    is_call = F.col("c").isNotNull()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_copies", "n_calls", "n_results")]
    return met.select("call_id", "position", is_call.alias("is_call"), (is_call & F.col("r").isNotNull()).alias("answered"), F.when(is_call, broken).alias("broken"), record.alias("record"), *counts).select(
        "call_id", "position", "is_call", "answered", F.coalesce(F.size("broken"), F.lit(0)).cast("long").alias("n_violations"), F.coalesce(F.array_join("broken", ","), F.lit("")).alias("violations"), "record", "n_copies", "n_calls", "n_results"
    )


SCHEMA = {"properties": {"prompt": {"type": "string", "minLength": 20, "maxLength": 400, "pattern": r"^[^\[{<]"}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"], "additionalProperties": False}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns: a user's turn calls for a reply, and the assistant's next turn is its result. A user's turn builds on the user's turn two before it, where there is one."""
    name = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    turns = conversations.select("conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    calls = turns.filter(F.col("role") == "user").select(name(0).alias("call_id"), F.array(name(2)).alias("parent_ids"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    return calls, turns.filter(F.col("role") == "assistant").select(name(1).alias("call_id"), F.col("text").alias("content"))


def op2_tool_calls(conversations: DataFrame) -> DataFrame:
    linked = link(*from_turns(conversations), SCHEMA)
    return linked.select("call_id", "position", "is_call", "answered", "n_violations", "violations", F.length("record").cast("long").alias("record_chars"), F.sha2("record", 256).alias("record_sha256"), "n_copies", "n_calls", "n_results")


OP2_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (SELECT conv_id, turn, count(*) AS n_copies FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
c AS (SELECT conv_id, turn, min(text) AS prompt FROM t WHERE role = 'user' GROUP BY ALL),
v AS (SELECT conv_id, turn, count(*) AS n_calls FROM t WHERE role = 'user' GROUP BY ALL),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n_results FROM t WHERE role = 'assistant' GROUP BY ALL),
g AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM c),
p AS (SELECT conv_id, turn, prompt, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS position FROM g),
m AS (
  SELECT coalesce(p.conv_id, r.conv_id) || ':' || coalesce(p.turn, r.turn) AS call_id, position, p.conv_id IS NOT NULL AS is_call, p.conv_id IS NOT NULL AND r.conv_id IS NOT NULL AS answered,
    CASE WHEN p.conv_id IS NULL THEN [] ELSE list_filter([
      CASE WHEN length(prompt) > 400 THEN 'prompt:maxLength' END,
      CASE WHEN length(prompt) < 20 THEN 'prompt:minLength' END,
      CASE WHEN NOT regexp_matches(prompt, '^[^\\[{<]') THEN 'prompt:pattern' END,
      CASE WHEN prompt IS NULL THEN 'prompt:required' END,
      CASE WHEN p.turn < 0 THEN 'turn:minimum' END], lambda x: x IS NOT NULL) END AS broken,
    '{"arguments":' || CASE WHEN p.conv_id IS NULL THEN 'null' ELSE '{"prompt":' || to_json(prompt)::VARCHAR || ',"turn":' || p.turn || '}' END
      || ',"id":"' || call_id || '","name":' || CASE WHEN p.conv_id IS NULL THEN 'null' ELSE '"reply"' END || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS record,
    coalesce(n_copies, 0) AS n_copies, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results
  FROM p JOIN n USING (conv_id, turn) JOIN v USING (conv_id, turn) FULL JOIN r ON p.conv_id = r.conv_id AND p.turn = r.turn)
SELECT call_id, position, is_call, answered, len(broken)::BIGINT AS n_violations, array_to_string(broken, ',') AS violations, length(record)::BIGINT AS record_chars, sha256(record) AS record_sha256, n_copies, n_calls, n_results FROM m
"""
