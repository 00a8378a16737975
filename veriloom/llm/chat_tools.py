"""Chat formatting: tool-call linking, in DataFrame operations only.

Calls and results meet in a hash join on conversation and call identifier, each side reduced to one row an identifier
before. Arguments are parsed, held against the tool's schema and written as canonical JSON (sorted keys, no blanks).
Calls are ordered topologically by what they come after: every call has a level, one more than the highest level that
it needs. Chains of calls that need one other each are followed by pointer doubling, in as many rounds as the length
of the longest has binary digits; what is left, calls that need several, is peeled level by level. The result has a
row for each call, so that a conversation of any length never meets in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import save, table

#: Schemas are rows: name of the tool, and its fields with type and whether they are required.
SCHEMA = "name string, fields array<struct<field string, type string, required boolean>>"
#: The level of what runs into a circle, above all others.
ENDLESS = 1 << 40
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "object": "OBJECT.*", "array": "ARRAY.*"}


def canonical(json: Column) -> Column:
    """The same JSON with keys sorted and without blanks; null if it doesn't parse."""
    return F.to_json(F.try_parse_json(json))


def argument_errors(arguments: Column, fields: Column) -> Column:
    """Errors of a call's arguments (JSON text) against a schema's fields, sorted."""
    parsed = F.from_json(F.when(F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), arguments), "map<string,variant>")

    def one(f: Column) -> Column:
        kind = F.schema_of_variant(F.try_element_at(parsed, f.field))
        want = F.lit(None)
        for k, v in TYPES.items():
            want = F.when(f.type == k, F.lit(f"^(?:{v})$")).otherwise(want)
        missing = kind.isNull() | (kind == "VOID")
        return F.when(missing & f.required, F.concat(F.lit("missing:"), f.field)).when(~missing & ~F.coalesce(F.rlike(kind, want), F.lit(False)), F.concat(F.lit("type:"), f.field))

    unknown = F.transform(F.array_except(F.map_keys(parsed), F.transform(fields, lambda f: f.field)), lambda k: F.concat(F.lit("unknown:"), k))
    found = F.array_sort(F.concat(F.array_compact(F.transform(fields, one)), unknown))
    return F.when(fields.isNull(), F.array(F.lit("no_schema"))).when(parsed.isNull(), F.array(F.lit("not_an_object"))).otherwise(found)


def _followed(own: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, id and level of calls that each follow one chosen need (conv_id, id, to): the number of steps to a call
    that follows none, ENDLESS for what runs into a circle. Every pointer goes twice as far in each round."""
    jump = own.join(chosen, ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce("to", "id").alias("to"), F.col("to").isNotNull().cast("long").alias("steps"))
    jump = save(jump, "chat-jumps")
    ends = save(jump.filter("steps = 0").select("conv_id", F.col("id").alias("to")), "chat-ends")
    size, count = 1, chosen.count()
    while size < count:  # no chain is longer than there are calls in it
        there = jump.select("conv_id", F.col("id").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        further = save(jump.join(there, ["conv_id", "to"]).select("conv_id", "id", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("far") != F.col("to")).alias("moved")), "chat-jumps")
        jump, size = further.drop("moved"), 2 * size
        if further.filter("moved").isEmpty():
            break
    done = jump.join(ends.withColumn("ended", F.lit(True)), ["conv_id", "to"], "left")
    return done.select("conv_id", "id", F.when(F.col("ended"), F.col("steps")).otherwise(F.lit(ENDLESS)).alias("level"))


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, id and level of calls with conv_id, id and after (ids), each id once in a conversation.

    Level 0 needs nothing that is there; other calls are one above the highest that they need. Calls in a circle, and
    what needs them, have level -1. Needs that name no call of the conversation don't count.

    Every call follows one of its needs, and levels are the lengths of these chains. Calls with a need of a higher level
    than the one that they follow follow that one instead, until there are none: then every level is one above the
    highest. A ladder whose rungs need the two below takes three such turns, whatever its height.
    """
    own = calls.select("conv_id", "id")
    named = calls.select("conv_id", "id", F.explode(F.array_distinct("after")).alias("need")).filter("need is not null")
    edges = save(named.join(own.withColumnRenamed("id", "need"), ["conv_id", "need"], "left_semi").select("conv_id", "id", "need"), "chat-needs")
    chosen = save(edges.groupBy("conv_id", "id").agg(F.min("need").alias("to")), "chat-chosen")
    while True:
        levels = save(_followed(own, chosen), "chat-levels")
        highest = edges.join(levels.select("conv_id", F.col("id").alias("need"), "level"), ["conv_id", "need"]).groupBy("conv_id", "id").agg(F.max(F.struct("level", "need")).alias("x"))
        better = highest.join(levels, ["conv_id", "id"]).filter("x.level + 1 > level and level < " + str(ENDLESS)).select("conv_id", "id", F.col("x.need").alias("better"))
        better = save(better, "chat-better")
        if better.isEmpty():
            return levels.select("conv_id", "id", F.when(F.col("level") == ENDLESS, -1).otherwise(F.col("level")).cast("long").alias("level"))
        chosen = save(chosen.join(better, ["conv_id", "id"], "left").select("conv_id", "id", F.coalesce("better", "to").alias("to")), "chat-chosen")


def link_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Links the calls and results of a table with conv_id, turn, calls and result_of, content.

    calls is an array of id, name, arguments (JSON text) and after (ids); result_of the id that a message answers,
    content the answer. Returns conv_id, id, status (linked, open_call, lost_result), n_calls and n_results with
    that id, call_turn, result_turn, level (level and then call_turn are a topological order within the conversation;
    -1 in circles and behind them), errors, valid, json.

    Of several calls or results of one id, the first by turn counts (ties: by place, then value). Calls and results
    without id or conv_id are never linked and keep rows of their own. Invalid JSON is an error, and stays in
    json as the text of an object. Tables may be empty; other columns of messages are not looked at.
    """
    each = messages.select("conv_id", "turn", F.posexplode("calls").alias("idx", "call")).select("conv_id", "turn", "idx", "call.*")
    named = F.col("conv_id").isNotNull() & F.col("id").isNotNull()
    pick = lambda keys: F.min(F.struct(*keys)).alias("x")
    fields = ["turn", "idx", "name", "arguments", "after"]
    calls = each.filter(named).groupBy("conv_id", "id").agg(pick(fields), F.count(F.lit(1)).alias("n_calls")).select("conv_id", "id", "n_calls", "x.*")
    calls = calls.unionByName(each.filter(~named).withColumn("n_calls", F.lit(1).cast("long")).select("conv_id", "id", "n_calls", *fields))
    calls = save(calls.withColumn("after", F.coalesce("after", F.array().cast("array<string>"))), "chat-calls")
    answers = messages.filter("result_of is not null or (size(calls) = 0 and content is not null)").select("conv_id", F.col("result_of").alias("id"), F.col("turn").alias("result_turn"), F.col("content").alias("result"))
    results = answers.filter(named).groupBy("conv_id", "id").agg(pick(["result_turn", "result"]), F.count(F.lit(1)).alias("n_results")).select("conv_id", "id", "n_results", "x.*")
    results = results.unionByName(answers.filter(~named).withColumn("n_results", F.lit(1).cast("long")).select(*results.columns))
    both = calls.join(results, ["conv_id", "id"], "full_outer")
    both = both.join(schemas, "name", "left").join(call_levels(calls.filter(named)), ["conv_id", "id"], "left")
    errors = F.when(F.col("n_calls").isNotNull(), argument_errors(F.col("arguments"), F.col("fields"))).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("n_calls").isNull(), "lost_result").when(F.col("n_results").isNull(), "open_call").otherwise("linked")
    said = F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(F.to_json(F.struct(F.col("arguments").alias("text")))))
    record = F.to_json(F.struct("after", F.when(F.col("arguments").isNotNull(), said).alias("arguments"), "id", "name", "result"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = both.select("conv_id", "id", status.alias("status"), count("n_calls"), count("n_results"), F.col("turn").alias("call_turn"), "result_turn", F.coalesce("level", F.lit(0)).cast("long").alias("level"), errors.alias("errors"), canonical(record).alias("json"))
    return rows.withColumn("valid", (F.col("status") != "lost_result") & (F.size("errors") == 0))


def as_messages(turns: DataFrame) -> DataFrame:
    """Turns of chats as calls and results. A user's turn calls the tool `reply`. Of two user's turns in a row, the
    first waits for the second, and the second comes after the last pair's; so needs run backwards and forwards. An
    assistant's turn is the result of the turn before it; others are plain messages, results of nothing."""
    name = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    call = F.struct(F.when(known, name(0)).alias("id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), F.when(known & (F.col("turn") % 4 < 2), F.array(name(-2))).when(known & (F.col("turn") >= 4), F.array(name(4))).otherwise(F.array().cast("array<string>")).alias("after"))
    calls = F.when(F.col("role") == "user", F.array(call)).otherwise(F.array().cast(f"array<{'struct<id:string,name:string,arguments:string,after:array<string>>'}>"))
    return turns.select("conv_id", "turn", calls.alias("calls"), F.when(known & (F.col("role") == "assistant"), name(1)).alias("result_of"), F.when(F.coalesce(F.col("role") != "user", F.lit(True)), F.coalesce("text", F.lit(""))).alias("content"))


def reply_schema(spark) -> DataFrame:
    fields = "array(struct('prompt' as field, 'string' as type, true as required), struct('turn' as field, 'integer' as type, true as required))"
    return spark.sql(f"select 'reply' as name, {fields} as fields")


def op1(spark, sf_dir: str) -> DataFrame:
    """Query: linked, checked and ordered calls of all conversations, as canonical JSON."""
    rows = link_calls(as_messages(table(spark, sf_dir, "conversations")), reply_schema(spark))
    return rows.select("conv_id", "id", "status", "n_calls", "n_results", "call_turn", "result_turn", F.col("level").cast("long").alias("level"), F.array_join("errors", ",").alias("errors"), "valid", "json")


OP1_SQL = """
WITH c AS (
  SELECT conv_id, concat(conv_id, '-', turn) AS id, min(turn) AS call_turn, count(*) AS n_calls,
         min(CASE WHEN text IS NULL THEN json_object('turn', turn) ELSE json_object('prompt', text, 'turn', turn) END::VARCHAR) AS arguments
  FROM conversations WHERE role = 'user' GROUP BY ALL
), r AS (
  SELECT conv_id, concat(conv_id, '-', turn - 1) AS id, min(turn) AS result_turn, count(*) AS n_results, min(coalesce(text, '')) AS result
  FROM conversations WHERE role = 'assistant' GROUP BY ALL
  UNION ALL
  SELECT conv_id, NULL, turn, 1, coalesce(text, '') FROM conversations WHERE role NOT IN ('user', 'assistant') OR role IS NULL
), steps AS (
  SELECT *, turn - 4 * row_number() OVER (PARTITION BY conv_id, turn % 4 ORDER BY turn) AS island
  FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user' AND turn % 4 >= 2)
), second AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 4, island ORDER BY turn) - 1 AS level FROM steps
), levels AS (
  SELECT conv_id, turn, level FROM second
  UNION ALL
  SELECT c.conv_id, c.call_turn, coalesce(s.level + 1, 0) FROM c LEFT JOIN second s ON s.conv_id = c.conv_id AND s.turn = c.call_turn + 2 WHERE c.call_turn % 4 < 2
), b AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.id, r.id) AS id, call_turn, n_calls, arguments, result_turn, n_results, result
  FROM c FULL OUTER JOIN r ON c.conv_id = r.conv_id AND c.id = r.id
)
SELECT b.conv_id, id,
  CASE WHEN n_calls IS NULL THEN 'lost_result' WHEN n_results IS NULL THEN 'open_call' ELSE 'linked' END AS status,
  coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_results, 0)::BIGINT AS n_results, call_turn, result_turn, coalesce(l.level, 0)::BIGINT AS level,
  CASE WHEN n_calls IS NOT NULL AND NOT contains(arguments, '"prompt"') THEN 'missing:prompt' ELSE '' END AS errors,
  n_calls IS NOT NULL AND contains(arguments, '"prompt"') AS valid,
  '{' || array_to_string(list_filter([
    CASE WHEN n_calls IS NOT NULL THEN '"after":[' || CASE WHEN call_turn % 4 < 2 THEN to_json(concat(b.conv_id, '-', call_turn + 2))::VARCHAR WHEN call_turn >= 4 THEN to_json(concat(b.conv_id, '-', call_turn - 4))::VARCHAR ELSE '' END || ']' END,
    '"arguments":' || arguments, '"id":' || to_json(id)::VARCHAR, CASE WHEN n_calls IS NOT NULL THEN '"name":"reply"' END,
    '"result":' || to_json(result)::VARCHAR], lambda x: x IS NOT NULL AND x <> '"id":null'), ',') || '}' AS json
FROM b LEFT JOIN levels l ON l.conv_id = b.conv_id AND l.turn = b.call_turn
"""
