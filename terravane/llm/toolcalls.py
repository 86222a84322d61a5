"""Linking tool calls with their results, in DataFrame operations only.

Calls and results meet in hash joins by identifier.  A call may need the results of other calls;
the order puts every result after its call and every call after what it needs.  Arguments are
validated against a schema for each tool.  Every message becomes a line of canonical JSON: keys in
code point order on every level, no blanks between tokens, missing values left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import drop_stages, shared_folder, write_stage


def kind_of(value: Column) -> Column:
    """The JSON type of a variant; whole numbers are integers."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when(name == "BIGINT", "integer")
        .otherwise("number")
    )


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """The calls whose arguments break their tool's schema: ``(row, errors)``, sorted and distinct.

    ``calls`` has ``row`` (a number of its own for each call), ``tool`` and ``arguments`` (JSON
    text).  ``schemas`` has a row for each parameter: ``tool``, ``parameter``, ``kind`` (a JSON
    type; an integer is a number too) and ``required``.  Arguments must be an object with distinct
    keys; text that is none, or that exceeds a variant's size, is one error, and a tool without
    schema another.
    """
    parsed = calls.select("row", "tool", F.try_parse_json("arguments").alias("v"))
    known = schemas.groupBy("tool").agg(F.count("*").alias("_n")).withColumnRenamed("tool", "_tool")
    parsed = parsed.join(known, F.col("tool") == F.col("_tool"), "left")
    broken = F.when(F.col("_n").isNull(), "unknown tool").when(F.col("v").isNull() | (kind_of(F.col("v")) != "object"), "no object")
    parsed = parsed.withColumn("broken", broken)
    spark = calls.sparkSession
    given = parsed.filter("broken is null").select("row", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    given = given.select("row", F.col("key").alias("parameter"), kind_of(F.col("value")).alias("got"))
    wanted = parsed.filter("broken is null").select("row", "tool").join(schemas, "tool").select("row", "parameter", "kind", "required")
    both = given.join(wanted, ["row", "parameter"], "full_outer")
    wrong = (
        F.when(F.col("got").isNull() & F.col("required"), F.concat(F.lit("missing: "), "parameter"))
        .when(F.col("kind").isNull(), F.concat(F.lit("unexpected: "), "parameter"))
        .when((F.col("got") != F.col("kind")) & ~((F.col("kind") == "number") & (F.col("got") == "integer")), F.concat(F.lit("not "), "kind", F.lit(": "), "parameter"))
    )
    errors = both.select("row", wrong.alias("error")).union(parsed.select("row", "broken")).filter("error is not null")
    return errors.groupBy("row").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def depths(calls: DataFrame, folder: str) -> DataFrame:
    """``(id, depth)``: 0 for calls that need nothing, else one more than the deepest they need.

    ``calls`` has ``id`` and ``needs``, an array of ids.  Needs without such a call do not count.
    Calls on a cycle, and those that need them, are absent.  Chains, whose calls need one other
    each, are followed by doubling; so rounds grow as the logarithm of a chain's length, and
    beyond that only with the number of calls on a path that need several.
    """
    spark = calls.sparkSession
    ids = calls.select("id").distinct()
    needs = calls.select("id", F.explode("needs").alias("need")).distinct()
    needs = write_stage(needs.join(ids.withColumnRenamed("id", "need"), "need").select("id", "need"), folder, "needs")
    totals = needs.groupBy("id").agg(F.count("*").alias("n"), F.min("need").alias("top"))
    # Where a chain leads: to a call that needs nothing or several others.
    chains = write_stage(totals.filter("n = 1").select("id", "top", F.lit(1).cast("long").alias("far")), folder, "chains-0")
    count, k = chains.count(), 0
    while 1 << k < 2 * count:
        k += 1
        beyond = chains.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("far").alias("more"))
        joined = chains.join(beyond, "top", "left")
        if joined.filter("next is not null").isEmpty():
            break
        joined = joined.select("id", F.coalesce("next", "top").alias("top"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        chains = write_stage(joined, folder, f"chains-{k}")
        drop_stages(spark, folder, f"chains-{k - 1}")
    # What still leads into a chain is on a cycle, or behind one.
    chains = chains.join(chains.select(F.col("id").alias("top")), "top", "left_anti")

    known = write_stage(ids.join(totals.select("id"), "id", "left_anti").withColumn("depth", F.lit(0).cast("long")), folder, "known-0")
    several = needs.join(totals.filter("n > 1").select("id", "n"), "id")
    single = chains.select(F.col("id").alias("need"), "top", "far")
    # A need on a chain that leads nowhere stays itself, and is never known.
    several = several.join(single, "need", "left").select("id", "n", F.coalesce("top", "need").alias("top"), F.coalesce("far", F.lit(0)).alias("far"))
    several, k = write_stage(several, folder, "several"), 0
    while not several.isEmpty():
        met = several.join(known.withColumnRenamed("id", "top"), "top").groupBy("id").agg(F.count("*").alias("met"), F.first("n").alias("n"), F.max(F.expr("depth + far + 1")).alias("depth"))
        new = met.filter("met = n").select("id", "depth").join(known.select("id"), "id", "left_anti")
        k += 1
        new = write_stage(new, folder, f"new-{k}")
        if new.isEmpty():
            break
        known = write_stage(known.union(new), folder, f"known-{k}")
        drop_stages(spark, folder, f"known-{k - 1}", f"new-{k}")
    return known.union(chains.join(known.withColumnRenamed("id", "top"), "top").select("id", F.expr("depth + far")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls and results in topological order: one row for each, with status, errors and JSON.

    ``calls``: ``conv_id``, ``turn``, ``call_id``, ``tool``, ``arguments`` (JSON text), ``needs``
    (array of call ids, may be null).  ``results``: ``conv_id``, ``turn``, ``call_id``, ``content``.
    Identifiers hold within a conversation; a null conv_id is one conversation.  Sorting it by
    ``(step, turn)`` is a topological order: a call at depth d has step 2 d, its result 2 d + 1.
    ``status`` of a call is ``linked``, ``unanswered``, ``ambiguous`` (several calls have its
    identifier) or ``cyclic``; of a result ``linked``, ``orphan`` (no such call), ``ambiguous`` or
    ``cyclic``.  Null identifiers meet nothing and have no step; their calls are validated like
    all others, each call by its own arguments.  Cyclic rows, ambiguous identifiers aside, and
    orphans have no step.  Repeated results of one call are all linked, and a long text is one
    row's.  Empty tables give no rows.  Other columns, whatever their names, are not carried.
    """
    folder = shared_folder(calls.sparkSession)

    def scoped(name: Column) -> Column:
        return F.when(name.isNotNull(), F.struct(F.col("conv_id").cast("string").alias("c"), name.cast("string").alias("i")))

    calls = calls.select("conv_id", "turn", "call_id", "tool", "arguments", "needs", scoped(F.col("call_id")).alias("id"))
    results = results.select("conv_id", "turn", "call_id", "content", scoped(F.col("call_id")).alias("id"))
    calls = write_stage(calls.withColumn("row", F.monotonically_increasing_id()), folder, "calls")
    named = calls.filter("id is not null").select("id", F.transform(F.filter("needs", lambda x: x.isNotNull()), scoped).alias("needs"))
    about = named.groupBy("id").agg(F.count("*").alias("n_calls"))
    answers = results.filter("id is not null").groupBy("id").agg(F.count("*").alias("n_results"))
    about = write_stage(about.join(answers, "id", "left").join(depths(named, folder), "id", "left"), folder, "about")

    none = F.array().cast("array<string>")
    made = calls.join(about, "id", "left").join(argument_errors(calls, schemas), "row", "left")
    status = F.when(F.col("n_calls") > 1, "ambiguous").when(F.col("n_calls").isNotNull() & F.col("depth").isNull(), "cyclic").when(F.col("n_results") > 0, "linked").otherwise("unanswered")
    step = F.col("depth").cast("int") * 2
    made = made.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", step.alias("step"), status.alias("status"), F.coalesce("errors", none).alias("errors"), F.try_parse_json("arguments").alias("arguments"), F.lit(None).cast("string").alias("content"), "tool")
    got = results.join(about, "id", "left")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_calls") > 1, "ambiguous").when(F.col("depth").isNull(), "cyclic").otherwise("linked")
    got = got.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", (step + 1).alias("step"), status.alias("status"), none.alias("errors"), F.lit(None).cast("variant").alias("arguments"), "content", F.lit(None).cast("string").alias("tool"))
    both = made.union(got)
    line = F.to_json(F.struct("arguments", "call_id", "content", "conv_id", F.when(F.size("errors") > 0, F.col("errors")).alias("errors"), "kind", "status", "step", "tool", "turn"))
    return both.select("conv_id", "turn", "kind", "call_id", "step", "status", "errors", line.alias("json"))


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads plain conversations as calls and results.

    A user's turn calls the tool ``reply`` with the prompt (left out if the text is null), its
    turn, its number of characters and, if it has several, of lines; it needs the conversation's
    first call.  Any other turn is a result for the turn before it.  Other columns are not read.
    """

    def name(turn: Column) -> Column:
        return F.concat_ws("-", F.lit("call"), F.col("conv_id"), turn)

    messages = messages.select("conv_id", "turn", "role", "text")
    users = messages.filter("role = 'user'")
    # First turns are aggregated before they meet the turns, so a long conversation is no single task's.
    first = users.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("turn").alias("_first"))
    calls = users.join(first, F.col("conv_id") == F.col("_conv"), "left")
    size = F.length(F.coalesce("text", F.lit("")))
    lines = size - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    arguments = F.to_json(F.struct(size.alias("chars"), F.when(lines > 1, lines).alias("lines"), F.col("text").alias("prompt"), "turn"))
    calls = calls.select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"), arguments.alias("arguments"), F.when(F.col("turn") > F.col("_first"), F.array(name(F.col("_first")))).alias("needs"))
    rest = messages.filter("role is null or role <> 'user'")
    return calls, rest.select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


#: Parameters of the tool that plain conversations call.
REPLY = [
    {"tool": "reply", "parameter": "chars", "kind": "integer", "required": True},
    {"tool": "reply", "parameter": "lines", "kind": "integer", "required": False},
    {"tool": "reply", "parameter": "prompt", "kind": "string", "required": True},
    {"tool": "reply", "parameter": "turn", "kind": "integer", "required": True},
]
SCHEMA = "tool string, parameter string, kind string, required boolean"

#: The same for an independent engine.
CONVERSATIONS_SQL = """
WITH users AS (SELECT *, length(coalesce(text, '')) AS size, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines FROM conversations WHERE role = 'user'),
first AS (SELECT conv_id, min(turn) AS first FROM users GROUP BY conv_id),
calls AS (SELECT u.*, 'call-' || u.conv_id || '-' || u.turn AS call_id, CASE WHEN u.turn > f.first THEN 1 ELSE 0 END AS depth FROM users u LEFT JOIN first f ON u.conv_id = f.conv_id),
results AS (SELECT *, 'call-' || conv_id || '-' || (turn - 1) AS call_id FROM conversations WHERE role IS NULL OR role <> 'user'),
about AS (SELECT call_id, count(*) AS n_calls, min(depth) AS depth FROM calls GROUP BY call_id),
answers AS (SELECT call_id, count(*) AS n_results FROM results GROUP BY call_id),
made AS (
  SELECT c.conv_id, c.turn, 'call' AS kind, c.call_id, CAST(c.depth * 2 AS INTEGER) AS step,
    CASE WHEN a.n_calls > 1 THEN 'ambiguous' WHEN r.n_results > 0 THEN 'linked' ELSE 'unanswered' END AS status,
    list_filter([CASE WHEN c.text IS NULL THEN 'missing: prompt' END], lambda x: x IS NOT NULL) AS errors,
    c.text, c.size, c.lines
  FROM calls c JOIN about a ON c.call_id = a.call_id LEFT JOIN answers r ON c.call_id = r.call_id),
got AS (
  SELECT r.conv_id, r.turn, 'result' AS kind, r.call_id, CAST(a.depth * 2 + 1 AS INTEGER) AS step,
    CASE WHEN a.n_calls IS NULL THEN 'orphan' WHEN a.n_calls > 1 THEN 'ambiguous' ELSE 'linked' END AS status,
    CAST([] AS VARCHAR[]) AS errors, r.text
  FROM results r LEFT JOIN about a ON r.call_id = a.call_id)
SELECT conv_id, turn, kind, call_id, step, status, array_to_string(errors, ';') AS errors,
  '{"arguments":{"chars":' || size || CASE WHEN lines > 1 THEN ',"lines":' || lines ELSE '' END || CASE WHEN text IS NOT NULL THEN ',"prompt":' || to_json(text) ELSE '' END || ',"turn":' || turn || '}'
  || ',"call_id":' || to_json(call_id) || ',"conv_id":' || conv_id || CASE WHEN len(errors) > 0 THEN ',"errors":' || to_json(errors) ELSE '' END
  || ',"kind":"call","status":"' || status || '","step":' || step || ',"tool":"reply","turn":' || turn || '}' AS json FROM made
UNION ALL
SELECT conv_id, turn, kind, call_id, step, status, '' AS errors,
  '{"call_id":' || to_json(call_id) || ',"content":' || to_json(text) || ',"conv_id":' || conv_id || ',"kind":"result","status":"' || status || '"'
  || CASE WHEN step IS NULL THEN '' ELSE ',"step":' || step END || ',"turn":' || turn || '}' AS json FROM got
"""
