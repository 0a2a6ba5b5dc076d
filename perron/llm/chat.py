"""Op 5: link tool calls with their results, order them, validate arguments, serialise. DataFrame functions only.

Calls and results meet in a hash join on the call's identifier. A call may name calls that it comes after; levels of the
topological order are found by doubling jumps along runs of calls and rounds of joins where calls come after several, each
written to the shared folder. Arguments are parsed as variants and held against the schema of their tool. Every record is one line of canonical JSON: keys in
order, no spaces, nulls kept. Records stay rows, so a conversation of any size never gathers in one task.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: JSON types of a schema, and how a variant of that type describes itself.
TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<",
    "array": "^ARRAY<",
    "null": "^VOID$",
}
SCHEMA_LIMIT = 10_000


def canonical(json: Column) -> Column:
    """Canonical form of a JSON text: keys sorted at every level, no spaces; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def unique_calls(calls: DataFrame) -> DataFrame:
    """One row for each call_id: of several, the one with the smallest (name, arguments). Null ids are dropped."""
    rest = [c for c in calls.columns if c != "call_id"]
    return calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("name", "arguments", *[c for c in rest if c not in ("name", "arguments")])).alias("c")).select("call_id", *[F.col(f"c.{c}").alias(c) for c in rest])


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with canonical arguments, problems (array of text, in order) and valid.

    ``schemas`` is (name, parameters array<struct<name, type, required>>), one row for each tool; up to
    ``SCHEMA_LIMIT`` tools are broadcast, more are joined by shuffle. Problems: ``no such tool``, ``not an object``,
    ``missing: x``, ``unknown: x``, ``type: x``.
    """
    few = schemas.limit(SCHEMA_LIMIT + 1).count() <= SCHEMA_LIMIT
    known = schemas.groupBy("name").agg(F.min("parameters").alias("parameters"))
    both = calls.join(F.broadcast(known) if few else known, "name", "left")
    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).rlike("^OBJECT<"), F.lit(False))
    kinds = F.when(is_object, F.transform_values(F.when(is_object, parsed).cast("map<string,variant>"), lambda k, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))))
    both = both.withColumn("kinds", kinds)
    names = F.transform("parameters", lambda p: p["name"])
    pattern = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    missing = F.transform(F.filter("parameters", lambda p: p["required"] & ~F.map_contains_key("kinds", p["name"])), lambda p: F.concat(F.lit("missing: "), p["name"]))
    unknown = F.transform(F.filter(F.map_keys("kinds"), lambda k: ~F.array_contains(names, k)), lambda k: F.concat(F.lit("unknown: "), k))
    wrong = F.transform(
        F.filter("parameters", lambda p: F.map_contains_key("kinds", p["name"]) & ~F.regexp_like(F.element_at("kinds", p["name"]), F.coalesce(F.element_at(pattern, p["type"]), F.lit(".")))),
        lambda p: F.concat(F.lit("type: "), p["name"]),
    )
    problems = F.when(F.col("parameters").isNull(), F.array(F.lit("no such tool"))).when(F.col("kinds").isNull(), F.array(F.lit("not an object"))).otherwise(F.array_sort(F.concat(missing, unknown, wrong)))
    out = both.withColumns({"problems": problems, "arguments": F.coalesce(F.to_json(parsed), F.col("arguments"))})
    return out.withColumn("valid", F.size("problems") == 0).select(*calls.columns, "problems", "valid")


def topological(calls: DataFrame) -> DataFrame:
    """``calls`` (call_id, after array of call ids, ...) with level: 0 for calls that come after none, else 1 more than
    the largest level among those they come after. Unknown ids do not hold a call back; calls on or behind a cycle have
    a null level.

    Runs of calls that come after one call each are passed over by doubling jumps, in rounds of the logarithm of the
    longest run; rounds of joins remain only for calls that come after several.
    """
    spark = calls.sparkSession
    ids = calls.select("call_id")
    wanted = calls.select("call_id", F.explode(F.array_distinct("after")).alias("parent")).where("parent is not null")
    edges = shared.written(wanted.join(ids.withColumnRenamed("call_id", "parent"), "parent", "left_semi").select("call_id", "parent"), "call-edges")
    degree = edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("parent").alias("up"))
    jumps = shared.written(degree.where("n = 1").select("call_id", "up", F.lit(1).alias("far")), "call-jumps")
    for _ in range(max(1, jumps.count()).bit_length() + 1):
        over = jumps.select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        if not jumps.join(over, "up", "left_semi").limit(1).count():
            break
        both = jumps.join(over, "up", "left")
        further = shared.written(both.select("call_id", F.coalesce("up2", "up").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far")), "call-jumps")
        shared.discard(spark, jumps)
        jumps = further
    # what still points into a run never leaves it: a cycle
    known = ids.join(degree.select("call_id"), "call_id", "left_anti").withColumn("level", F.lit(0))
    several = degree.where("n > 1").select("call_id")
    if several.limit(1).count():
        by = jumps.select(F.col("call_id").alias("parent"), "up", "far")
        held = edges.join(several, "call_id", "left_semi").join(by, "parent", "left")
        held = shared.written(held.select("call_id", F.coalesce("up", "parent").alias("up"), (F.coalesce("far", F.lit(0)) + 1).alias("far")), "call-held")
        known = shared.written(known, "call-levels")
        for number in itertools.count(1):
            waiting = held.join(known.select("call_id"), "call_id", "left_anti").join(known.select(F.col("call_id").alias("up"), "level"), "up", "left")
            freed = waiting.groupBy("call_id").agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0").select("call_id", "level")
            freed = shared.written(freed, "call-levels")
            if not freed.limit(1).count():
                break
            known = known.unionByName(freed)
            if number % 8 == 0:  # else the union of all rounds would be planned anew in each
                known = shared.written(known, "call-levels")
    after_one = jumps.join(known.select(F.col("call_id").alias("up"), "level"), "up").select("call_id", (F.col("level") + F.col("far")).alias("level"))
    return calls.join(known.unionByName(after_one), "call_id", "left")


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls with answered, results with their call): hash joins on call_id.

    A result keeps its row whether or not its call exists (linked); of a call with several results each is linked.
    """
    answered = results.where("call_id is not null").select("call_id").distinct().withColumn("_hit", F.lit(True))
    told = calls.join(answered.hint("shuffle_hash"), "call_id", "left").withColumn("answered", F.coalesce("_hit", F.lit(False))).drop("_hit")
    of = calls.select(F.col("call_id"), F.col("name").alias("call_name"), F.col("level").alias("call_level"), F.col("valid").alias("call_valid"))
    linked = results.join(of.hint("shuffle_hash"), "call_id", "left").withColumn("linked", F.col("call_name").isNotNull())
    return told, linked


def default_schemas(spark: SparkSession) -> DataFrame:
    """The tools that turns of a conversation stand for."""
    rows = [
        ("ask", [("question", "string", True), ("turn", "integer", True)]),
        ("tell", [("text", "string", True), ("turn", "integer", True)]),
    ]
    return spark.createDataFrame(rows, "name string, parameters array<struct<name: string, type: string, required: boolean>>")


def turn_calls(messages: DataFrame) -> DataFrame:
    """Calls that user turns stand for: a text with a question mark asks, any other tells.

    call_id is ``call_<conv>_<turn>``; a call comes after the call two turns before it.
    """
    text = F.coalesce("text", F.lit(""))
    asks = F.contains(text, F.lit("?"))
    name = lambda back: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - back).cast("string"))
    return messages.where(F.col("role") == "user").select(
        name(0).alias("call_id"),
        F.when(asks, "ask").otherwise("tell").alias("name"),
        F.when(asks, F.to_json(F.struct(text.alias("question"), F.col("turn").alias("turn")))).otherwise(F.to_json(F.struct(text.alias("text"), F.col("turn").alias("turn")))).alias("arguments"),
        F.array(name(2)).alias("after"),
    )


def format_conversations(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, role, call_id, level, linked, valid, json) for each row of ``messages`` (conv_id, turn, role, text).

    User turns are calls and the turn after a call is its result if the assistant gives it; linked says whether the
    other half exists. Other turns are plain messages with null call_id and level. Null texts count as empty in calls
    and stay null in messages; rows with a null id or turn are plain messages; rows that repeat (conv_id, turn) share one
    call and keep a row each. An empty table gives no rows; other columns are not read.
    """
    own = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    calls = topological(validate(unique_calls(turn_calls(own)), schemas if schemas is not None else default_schemas(messages.sparkSession)))
    calls = shared.written(calls, "calls")
    place = lambda back: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - back).cast("string"))
    keyed = own.withColumn("kind", F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message"))
    keyed = keyed.withColumn("call_id", F.when(F.col("kind") == "call", place(0)).when(F.col("kind") == "result", place(1)))
    told, linked = link(calls, keyed.where("kind = 'result'").select("conv_id", "turn", "role", "text", "call_id"))
    asked = keyed.where("kind = 'call'").select("conv_id", "turn", "role", "text", "call_id").join(told.hint("shuffle_hash"), "call_id", "left")
    null = lambda t: F.lit(None).cast(t)
    line = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    common = ["conv_id", "turn", "role"]
    call_rows = asked.select(
        *common, "call_id", "level", F.coalesce("answered", F.lit(False)).alias("linked"), F.coalesce("valid", F.lit(False)).alias("valid"),
        line("arguments", "call_id", "conv_id", "level", "name", "problems", "role", "turn").alias("json"),
    )
    result_rows = linked.select(
        *common, F.when(F.col("linked"), F.col("call_id")).alias("call_id"), F.col("call_level").alias("level"), "linked", F.coalesce("call_valid", F.lit(False)).alias("valid"),
        line(F.when(F.col("linked"), F.col("call_id")).alias("call_id"), F.col("text").alias("content"), "conv_id", "role", "turn").alias("json"),
    )
    plain = keyed.where("kind = 'message'").select(
        *common, null("string").alias("call_id"), null("int").alias("level"), F.lit(False).alias("linked"), F.lit(True).alias("valid"),
        line(F.col("text").alias("content"), "conv_id", "role", "turn").alias("json"),
    )
    return call_rows.unionByName(result_rows).unionByName(plain)


SQL = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text FROM conversations),
calls AS (
  SELECT conv_id, turn, min(text) AS text FROM m WHERE role = 'user' GROUP BY conv_id, turn
), levels AS (
  SELECT c.conv_id, c.turn, 0 AS level FROM calls c LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2 WHERE p.turn IS NULL
  UNION ALL
  SELECT c.conv_id, c.turn, l.level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.turn = l.turn + 2
), told AS (
  SELECT c.*, l.level, 'call_' || c.conv_id || '_' || c.turn AS call_id, contains(c.text, '?') AS asks,
         EXISTS (SELECT 1 FROM m a WHERE a.role = 'assistant' AND a.conv_id = c.conv_id AND a.turn = c.turn + 1) AS answered
  FROM calls c JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn
)
SELECT m.conv_id, m.turn, m.role, t.call_id, t.level, t.answered AS linked, TRUE AS valid,
       '{"arguments":' || to_json(CAST(CASE WHEN asks THEN json_object('question', t.text, 'turn', t.turn) ELSE json_object('text', t.text, 'turn', t.turn) END AS VARCHAR))
       || ',"call_id":"' || t.call_id || '","conv_id":' || m.conv_id || ',"level":' || t.level || ',"name":"' || CASE WHEN asks THEN 'ask' ELSE 'tell' END
       || '","problems":[],"role":"user","turn":' || m.turn || '}' AS json
FROM m JOIN told t ON t.conv_id = m.conv_id AND t.turn = m.turn WHERE m.role = 'user'
UNION ALL
SELECT m.conv_id, m.turn, m.role, t.call_id, t.level, t.call_id IS NOT NULL, t.call_id IS NOT NULL,
       '{"call_id":' || coalesce('"' || t.call_id || '"', 'null') || ',"content":' || to_json(m.text) || ',"conv_id":' || m.conv_id || ',"role":"assistant","turn":' || m.turn || '}'
FROM m LEFT JOIN told t ON t.conv_id = m.conv_id AND t.turn = m.turn - 1 WHERE m.role = 'assistant'
UNION ALL
SELECT m.conv_id, m.turn, m.role, NULL, NULL, FALSE, TRUE,
       '{"content":' || to_json(m.text) || ',"conv_id":' || m.conv_id || ',"role":"' || m.role || '","turn":' || m.turn || '}'
FROM m WHERE m.role NOT IN ('user', 'assistant')
"""
