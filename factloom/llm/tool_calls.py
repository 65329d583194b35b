"""Chat formatting: tool-call linking, native.

Calls and results meet in one full outer hash join on (conversation, identifier).  Calls are put into an order in which
each comes after the calls it depends on; arguments are checked against the tool's schema; the linked call is written as
canonical JSON (keys sorted, no white space).

Order: a call's level is the length of the longest chain of dependencies below it (0: none), found by path doubling in
about two times log2 of that length joins; what depends on a cycle has no level and comes last.  Positions are counted in
small cells of turns, so that one huge conversation is not sorted in one task.

Defined results: null or broken argument JSON is an error ("json"), as are an unknown tool ("tool"), missing, unknown or
mistyped arguments; of several results of one call the earliest counts; a call without result is "unanswered", a result
without call "orphan"; dependencies on unknown calls are ignored; repeated calls are each kept and share their result
(and depend on what any of them depends on); rows with a null conversation or identifier link with nothing and are each
kept, such a call without a level; empty tables give an empty result; extra columns are ignored.  Turns that are neither
call nor result (those of the system) are no input of the linking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, durable

#: Tool -> argument -> (JSON type, required).
SCHEMAS = {
    "lookup": {"key": ("integer", True)},
    "search": {"limit": ("integer", False), "query": ("string", True)},
    "summarise": {"ratio": ("number", False), "text": ("string", True)},
}
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
CELL = 64


def argument_errors(name: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """Comma-joined errors of the arguments against the tool's schema; empty if there are none."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    keys = F.json_object_keys(arguments)
    out = F.array(F.lit("tool"))
    for tool, wanted in schemas.items():
        found: list[Column] = []
        for key, (kind, required) in sorted(wanted.items()):
            value = F.schema_of_variant(F.try_variant_get(parsed, f"$['{key}']", "variant"))
            given = F.array_contains(keys, key)
            wrong = F.when(given & ~F.coalesce(value.rlike(f"^{_TYPES[kind]}$"), F.lit(False)), F.lit(f"type:{key}"))
            found.append(wrong.when(~given, F.lit(f"missing:{key}")) if required else wrong)
        unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in sorted(wanted)]))), lambda k: F.concat(F.lit("unknown:"), k))
        out = F.when(name == tool, F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), unknown)).otherwise(out)
    return F.array_join(F.when(is_object, out).otherwise(F.array(F.lit("json"))), ",")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls on the longest chain of dependencies below a call; null if it ends in a cycle.

    ``steps[k]`` holds which calls lie exactly 2**k dependencies below a call.  A chain of n calls needs about log2(n)
    tables, each the last one joined with itself.  Then the length of the longest chain is found bit by bit from the top:
    a bit is set if some call lies that far below.  Chains that go on beyond the number of calls run in a circle.
    """
    nodes = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).select("conv_id", "call_id").distinct()
    wants = calls.select("conv_id", F.col("call_id").alias("top"), F.explode("depends_on").alias("call_id")).where(F.col("top").isNotNull()).distinct()
    edges = durable(wants.join(nodes, ["conv_id", "call_id"], "left_semi").select("conv_id", "top", F.col("call_id").alias("low")), "call-steps")
    calls_in = nodes.join(edges.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("calls"))
    most = calls_in.agg(F.max("calls")).first()[0]
    if not most:
        drop(edges)
        return nodes.withColumn("level", F.lit(0))
    steps = [edges]
    while 2 ** len(steps) <= most:
        below = steps[-1].select("conv_id", F.col("top").alias("low"), F.col("low").alias("lower"))
        wider = durable(steps[-1].join(below.hint("shuffle_hash"), ["conv_id", "low"]).select("conv_id", "top", F.col("lower").alias("low")).distinct(), "call-steps")
        if wider.isEmpty():
            drop(wider)
            break
        steps.append(wider)
    at = edges.select("conv_id", "top", F.col("top").alias("low"), F.lit(0).alias("level")).distinct()
    for k in reversed(range(len(steps))):
        reach = steps[k].select("conv_id", F.col("top").alias("low"), F.col("low").alias("lower"))
        moved = durable(at.join(reach.hint("shuffle_hash"), ["conv_id", "low"]).select("conv_id", "top", F.col("lower").alias("low"), (F.col("level") + 2**k).alias("level")).distinct(), "call-reach")
        rest = at.join(moved.select("conv_id", "top"), ["conv_id", "top"], "left_anti")
        old, at = at, durable(moved.unionByName(rest), "call-reach")
        drop(moved, *([old] if k + 1 < len(steps) else []))  # the first is no table of its own
    deep = at.select("conv_id", F.col("top").alias("call_id"), "level").distinct().join(calls_in, "conv_id")
    found = durable(deep.select("conv_id", "call_id", F.when(F.col("level") < F.col("calls"), F.col("level")).alias("level"), F.lit(True).alias("found")), "call-levels")
    drop(*steps, at)
    return nodes.join(found, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.when(F.col("found"), F.col("level")).otherwise(F.lit(0)).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per call and per orphan result.

    calls: conv_id, call_id, turn, name, arguments (JSON), depends_on (array of call ids).
    results: conv_id, call_id, turn, content.
    """
    calls = durable(calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends_on"), "calls")
    result = F.struct("turn", "content").alias("result")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = results.where(named).groupBy("conv_id", "call_id").agg(F.min(result).alias("result"))
    first = first.unionByName(results.where(~named).select("conv_id", "call_id", result))
    placed = calls.join(levels(calls).hint("shuffle_hash"), ["conv_id", "call_id"], "left").withColumn("is_call", F.lit(True))
    linked = placed.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer").withColumn("is_call", F.coalesce("is_call", F.lit(False)))
    status = F.when(~F.col("is_call"), F.lit("orphan")).when(F.col("result").isNull(), F.lit("unanswered")).otherwise(F.lit("answered"))
    errors = F.when(F.col("is_call"), argument_errors(F.col("name"), F.col("arguments"), schemas))
    arguments = F.to_json(F.try_parse_json("arguments"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.cast("string").alias("v"))), r"(?s)^\{(?:\"v\":)?|\}$", "")
    json = lambda key, value: F.concat(F.lit(f'"{key}":'), F.coalesce(F.when(value != "", value), F.lit("null")))
    record = F.concat(F.lit("{"), F.concat_ws(",", json("arguments", arguments), json("call_id", quoted(F.col("call_id"))), json("name", quoted(F.col("name"))), json("result", quoted(F.col("result.content")))), F.lit("}"))
    rows = linked.select("conv_id", "call_id", F.coalesce("turn", "result.turn").alias("turn"), "name", status.alias("status"), errors.alias("errors"), "level", record.alias("record"), (F.col("is_call") & F.col("level").isNull() & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).alias("in_cycle"))
    rows = durable(rows, "linked-calls").withColumn("cell", F.floor(F.col("turn") / CELL))
    by = ["conv_id", F.col("level").isNull(), "level", "cell"]
    per_cell = rows.groupBy("conv_id", "level", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), "cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_cell.select(*[F.col(c).alias(f"o_{c}") for c in ("conv_id", "level", "cell")], F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("turn", "call_id", "record"))
    same = F.col("conv_id").eqNullSafe(F.col("o_conv_id")) & F.col("level").eqNullSafe(F.col("o_level")) & F.col("cell").eqNullSafe(F.col("o_cell"))
    return rows.withColumn("rank", rank).join(offsets, same).select("conv_id", "call_id", "turn", "name", "status", "errors", "level", "in_cycle", (F.col("before") + F.col("rank") - 1).alias("position"), "record")


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read into plain conversations: each user turn calls a tool, each assistant turn answers turn - 1.

    The tool and faults of its arguments follow from the length of the text; calls build on the one two turns before in
    runs of four, and in every tenth conversation some point forwards (in every fiftieth with a cycle).
    """
    n, t, conv = F.length("text"), F.col("turn"), F.col("conv_id")
    text = F.col("text")
    search = F.when(n % 7 == 0, F.to_json(F.struct((n % 10).alias("limit")))).when(n % 11 == 0, F.to_json(F.struct(text.alias("query"), (n % 10).cast("string").alias("limit")))).otherwise(F.to_json(F.struct(text.alias("query"), (n % 10).alias("limit"))))
    lookup = F.when(n % 7 == 0, F.to_json(F.struct(text.alias("key")))).otherwise(F.to_json(F.struct(n.alias("key"))))
    summarise = F.when(n % 7 == 0, F.to_json(F.struct(text.alias("text"), F.lit(True).alias("extra")))).otherwise(F.to_json(F.struct(text.alias("text"), (n % 4).alias("ratio"))))
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("summarise")
    back = (t % 8 >= 2) & ((conv % 10 != 0) | (t % 8 >= 4) | (conv % 50 == 0))
    ahead = (conv % 10 == 0) & (t % 8 < 2)
    depends = F.when(back, F.array(F.concat(F.lit("c"), (t - 2).cast("string")))).when(ahead, F.array(F.concat(F.lit("c"), (t + 2).cast("string")))).otherwise(F.array().cast("array<string>"))
    arguments = F.when(n % 3 == 0, search).when(n % 3 == 1, lookup).otherwise(summarise)
    calls = turns.where("role = 'user'").select("conv_id", F.concat(F.lit("c"), t.cast("string")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    results = turns.where("role = 'assistant'").select("conv_id", F.concat(F.lit("c"), (t - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op4_tool_calls(spark, sf_dir: str) -> DataFrame:
    """All conversations read as tool calls, linked, ordered, validated and serialised."""
    return link(*calls_of(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


OP4_SQL = r"""
WITH RECURSIVE calls AS (
    SELECT conv_id, turn, text, length(text) AS n, 'c' || turn AS call_id,
           CASE WHEN turn % 8 >= 2 AND (conv_id % 10 <> 0 OR turn % 8 >= 4 OR conv_id % 50 = 0) THEN 'c' || (turn - 2)
                WHEN conv_id % 10 = 0 AND turn % 8 < 2 THEN 'c' || (turn + 2) END AS dep
    FROM conversations WHERE role = 'user'
), results AS (
    SELECT conv_id, 'c' || (turn - 1) AS call_id, min(turn) AS turn, arg_min(text, turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL
), shaped AS (
    SELECT *, CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'summarise' END AS name,
        CASE n % 3
            WHEN 0 THEN CASE WHEN n % 7 = 0 THEN '{"limit":' || (n % 10) || '}'
                             WHEN n % 11 = 0 THEN '{"limit":"' || (n % 10) || '","query":' || to_json(text) || '}'
                             ELSE '{"limit":' || (n % 10) || ',"query":' || to_json(text) || '}' END
            WHEN 1 THEN CASE WHEN n % 7 = 0 THEN '{"key":' || to_json(text) || '}' ELSE '{"key":' || n || '}' END
            ELSE CASE WHEN n % 7 = 0 THEN '{"extra":true,"text":' || to_json(text) || '}'
                      ELSE '{"ratio":' || (n % 4) || ',"text":' || to_json(text) || '}' END END AS arguments
    FROM calls
), edges AS (
    SELECT a.conv_id, a.call_id, b.call_id AS dep, (SELECT count(*) FROM calls c WHERE c.conv_id = a.conv_id) AS n_calls FROM calls a JOIN calls b ON a.conv_id = b.conv_id AND a.dep = b.call_id
), walk AS (
    SELECT conv_id, call_id, 0 AS depth FROM calls
    UNION
    SELECT e.conv_id, e.call_id, w.depth + 1 FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.dep = w.call_id WHERE w.depth < e.n_calls
), deep AS (SELECT conv_id, call_id, max(depth) AS depth FROM walk GROUP BY ALL),
judged AS (
    SELECT *, CASE name
        WHEN 'search' THEN concat_ws(',', CASE WHEN list_contains(keys, 'limit') AND NOT regexp_matches(json_type(arguments, '$.limit'), '^U?BIGINT$') THEN 'type:limit' END,
                                     CASE WHEN NOT list_contains(keys, 'query') THEN 'missing:query' WHEN json_type(arguments, '$.query') <> 'VARCHAR' THEN 'type:query' END)
        WHEN 'lookup' THEN concat_ws(',', CASE WHEN NOT list_contains(keys, 'key') THEN 'missing:key' WHEN NOT regexp_matches(json_type(arguments, '$.key'), '^U?BIGINT$') THEN 'type:key' END)
        ELSE concat_ws(',', CASE WHEN list_contains(keys, 'ratio') AND NOT regexp_matches(json_type(arguments, '$.ratio'), '^(U?BIGINT|DOUBLE)$') THEN 'type:ratio' END,
                       CASE WHEN NOT list_contains(keys, 'text') THEN 'missing:text' WHEN json_type(arguments, '$.text') <> 'VARCHAR' THEN 'type:text' END,
                       array_to_string(list_transform(list_sort(list_filter(keys, lambda k: k NOT IN ('ratio', 'text'))), lambda k: 'unknown:' || k), ','))
        END AS errors
    FROM (SELECT *, json_keys(arguments) AS keys FROM shaped)
), linked AS (
    SELECT coalesce(s.conv_id, r.conv_id) AS conv_id, coalesce(s.call_id, r.call_id) AS call_id, coalesce(s.turn, r.turn) AS turn, s.name,
           CASE WHEN s.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
           s.errors, CASE WHEN d.depth < k.n_calls THEN d.depth END AS level,
           s.call_id IS NOT NULL AND d.depth >= k.n_calls AS in_cycle,
           '{"arguments":' || coalesce(s.arguments, 'null') || ',"call_id":"' || coalesce(s.call_id, r.call_id) || '","name":' || coalesce('"' || s.name || '"', 'null')
               || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS record
    FROM judged s FULL JOIN results r ON s.conv_id = r.conv_id AND s.call_id = r.call_id
    LEFT JOIN deep d ON d.conv_id = s.conv_id AND d.call_id = s.call_id
    LEFT JOIN (SELECT conv_id, count(*) AS n_calls FROM calls GROUP BY ALL) k ON k.conv_id = s.conv_id
)
SELECT conv_id, call_id, turn, name, status, errors, level::INTEGER AS level, in_cycle,
       row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, call_id, record) - 1 AS position, record
FROM linked
"""
