"""Chat formatting: tool-call linking. DataFrame functions only.

Calls and results meet in one hash join on (conversation, call id), both sides first reduced to one row per id by an aggregate, so
repeated or hot ids never gather in a task. Arguments are checked against the tools' schemas (a bounded parameter) by expressions,
and each call is serialised as canonical JSON: keys sorted at every level, no white space, in the order that Spark's VARIANT keeps.

Topological order: a call depends on the calls whose ids its arguments name ("$id"). Sorting a conversation's calls by
(cyclic, release, level, turn, call_id) puts every call after those it depends on: release is the latest turn among a call and all it depends
on, level counts the steps among equal releases. `position` is the place in that order, from 1. Conversations whose references all
point to earlier turns need no search (release is the call's turn). In the others calls without open references are peeled off round by round
(stored joins of the open references with the calls just peeled), so rounds follow the longest chain of one conversation; what is
never peeled is in or behind a cycle: cyclic, with its own turn as release, after all others. Positions come from a range partitioning
with counts a partition, so a conversation of any length spreads over tasks.

Defined results: null ids never link and have no position (status orphan_result or unanswered); the earliest turn of several calls or
results with one id counts, with ties to the smaller name, arguments or content, the others are counted in n_calls and n_results;
arguments that aren't a JSON object have the error "not an object", unknown tools "unknown tool"; a reference to an id without a call, or to
itself, has the error "unknown reference" and no part in the order; turns, release, level and position that don't exist are -1; null texts
are empty; texts of any length are kept whole; extra columns, whatever their names, are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm._common import joined, stored

#: Conversations (8 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000

#: Argument types of JSON schema, by the type names of schema_of_variant.
TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY"}

#: Tools of the query: argument -> (type, required).
TOOLS = {"reply": {"text": ("string", True), "length": ("integer", True), "after": ("string", False)}, "configure": {"text": ("string", True), "length": ("integer", False)}}


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """array<string> of what is wrong with a call's arguments (a JSON string)."""
    v = F.try_parse_json(arguments)
    given = F.from_json(arguments, "map<string,string>")
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            x = F.try_variant_get(v, f'$["{field}"]', "variant")
            missing = F.lit(f"missing {field}") if required else F.lit(None).cast("string")
            there = F.array_contains(F.map_keys(given), field)
            checks.append(F.when(~there, missing).when(~F.coalesce(F.schema_of_variant(x), F.lit("VOID")).rlike(TYPES[kind]), F.lit(f"{field} is no {kind}")))
        extra = F.transform(F.array_sort(F.array_except(F.map_keys(given), F.array(*map(F.lit, fields)))), lambda k: F.concat(F.lit("unexpected "), k))
        out = F.when(name == tool, F.concat(F.array_compact(F.array(*checks)), extra)).otherwise(out)
    return F.when(F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike("^OBJECT"), out).otherwise(F.array(F.lit("not an object")))


def canonical(arguments: Column) -> Column:
    """The JSON with sorted keys and no white space; null where it isn't JSON."""
    return F.to_json(F.try_parse_json(arguments))


def ordered(calls: DataFrame) -> DataFrame:
    """release, level, cyclic, unknown_reference and position for calls (conv_id, call_id, turn, arguments), one row per id."""
    key = ["conv_id", "call_id"]
    calls = calls.where("conv_id is not null and call_id is not null")
    refs = calls.select(*key, "turn", F.explode(F.filter(F.map_values(F.from_json("arguments", "map<string,string>")), lambda x: x.startswith("$"))).alias("ref"))
    refs = refs.select(*key, "turn", F.expr("substring(ref, 2)").alias("on")).distinct()
    there = calls.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"))
    edges = stored(refs.join(there, ["conv_id", "on"], "left"))
    unknown = edges.where("on_turn is null or on = call_id").select(*key).distinct().withColumn("unknown_reference", F.lit(True))
    edges = edges.where("on_turn is not null and on <> call_id")
    hard = stored(edges.where("on_turn >= turn").select("conv_id").distinct())
    found = calls.select(*key, "turn", F.col("turn").alias("release"), F.lit(0).cast("long").alias("level"), F.lit(False).alias("cyclic"))
    if not hard.isEmpty():
        inside = joined(found, hard, ["conv_id"], "left_semi", F.col("call_id"), hard.count() <= BROADCAST_ROWS)
        open_ = stored(joined(edges, hard, ["conv_id"], "left_semi", F.col("call_id"), hard.count() <= BROADCAST_ROWS).select(*key, "turn", "on", F.lit(None).cast("long").alias("r"), F.lit(None).cast("long").alias("l")))
        new = stored(inside.join(open_.select(*key), key, "left_anti"))
        peeled = joined(found, hard, ["conv_id"], "left_anti", F.col("call_id"), hard.count() <= BROADCAST_ROWS).unionByName(new)
        while not new.isEmpty():
            on = new.select("conv_id", F.col("call_id").alias("on"), F.col("release").alias("r1"), F.col("level").alias("l1"))
            marked = stored(open_.join(on, ["conv_id", "on"], "left").select(*key, "turn", "on", F.coalesce("r", "r1").alias("r"), F.coalesce("l", "l1").alias("l")))
            state = marked.groupBy(*key, "turn").agg(F.count_if(F.col("r").isNull()).alias("waits"), F.max(F.struct("r", "l")).alias("d"))
            level = F.when(F.col("d.r") >= F.col("turn"), F.col("d.l") + 1).otherwise(0)
            new = stored(state.where("waits = 0").select(*key, "turn", F.greatest("turn", "d.r").alias("release"), level.alias("level"), F.lit(False).alias("cyclic")))
            open_ = stored(marked.join(new.select(*key), key, "left_anti"))
            peeled = peeled.unionByName(new)
        rest = open_.select(*key, "turn").distinct()
        found = peeled.unionByName(rest.select(*key, "turn", F.col("turn").alias("release"), F.lit(0).cast("long").alias("level"), F.lit(True).alias("cyclic")))
    found = found.join(unknown, key, "left").withColumn("unknown_reference", F.coalesce("unknown_reference", F.lit(False)))
    return positions(found).drop("turn")


def positions(calls: DataFrame) -> DataFrame:
    """calls with their position in the conversation's order."""
    order = ["cyclic", "release", "level", "turn", "call_id"]
    parts = stored(calls.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = parts.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    return within.join(offsets, ["conv_id", "part"]).withColumn("position", F.col("k") + F.col("before")).drop("part", "k", "before")


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per (conv_id, call_id) of calls (.., turn, name, arguments) or results (.., turn, content)."""
    key = ["conv_id", "call_id"]
    one = calls.groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments")).alias("c"), F.count("*").alias("n_calls"))
    one = stored(one.select(*key, "c.*", "n_calls"))
    back = results.groupBy(*key).agg(F.min(F.struct(F.col("turn").alias("result_turn"), F.col("content"))).alias("r"), F.count("*").alias("n_results"))
    both = one.join(ordered(one), key, "left").join(back.select(*key, "r.*", "n_results"), key, "full")
    status = F.when(F.col("n_calls").isNull(), "orphan_result").when(F.col("n_results").isNull(), "unanswered").when(F.col("result_turn") < F.col("turn"), "result_before_call").otherwise("linked")
    errors = F.when(F.col("n_calls").isNotNull(), F.concat(argument_errors(F.col("name"), F.col("arguments"), schemas), F.when(F.col("unknown_reference"), F.array(F.lit("unknown reference"))).otherwise(F.array().cast("array<string>"))))
    # Fields in the order of their names; arguments keep their own canonical text.
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.struct(F.col(c).alias("x")))).substr(F.lit(6), F.length(F.to_json(F.to_variant_object(F.struct(F.col(c).alias("x"))))) - 6), F.lit("null"))
    field = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quoted(c))
    text = F.concat(F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(',"id":'), field("call_id"), F.lit(',"name":'), field("name"), F.lit(',"result":'), field("content"), F.lit("}"))
    return both.select(
        *key, F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("result_turn", F.lit(-1)).alias("result_turn"), "name", status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce("release", F.lit(-1)).alias("release"), F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("position", F.lit(-1)).alias("position"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), errors.alias("errors"), (F.size(errors) == 0).alias("valid"), text.alias("canonical_json"),
    )


def calls_and_results(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of plain conversations (conv_id, turn, role, text): calls and results that need every part of the linking.

    Each assistant turn is a call of `reply`, each system turn one of `configure`. By the length of its text a reply names the call two
    turns later (length divisible by 3: such replies in a row make chains against the turns' order, one that is named back makes a cycle), the
    one two turns before (remainder 1) or none; where it is divisible by 7 it takes the id of the call two turns before. Each
    user turn is the result of the turn before it, or, where its length is divisible by 5, of the turn behind it."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    name = lambda t: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    size, turn = F.length("text"), F.col("turn")
    after = F.concat(F.lit("$"), F.when(size % 3 == 0, name(turn + 2)).when((size % 3 == 1) & (turn >= 3), name(turn - 2)))
    reply = F.to_json(F.struct("text", size.alias("length"), after.alias("after")))
    setup = F.to_json(F.struct("text"))
    said = turns.where(F.col("role").isin("assistant", "system"))
    own = F.when((F.col("role") == "assistant") & (turn >= 3) & (size % 7 == 0), name(turn - 2)).otherwise(name(turn))
    calls = said.select("conv_id", own.alias("call_id"), "turn", F.when(F.col("role") == "assistant", "reply").otherwise("configure").alias("name"), F.when(F.col("role") == "assistant", reply).otherwise(setup).alias("arguments"))
    results = turns.where("role = 'user' and turn > 0").select("conv_id", name(F.when(size % 5 == 0, turn + 1).otherwise(turn - 1)).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_and_results(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = linked_calls(calls, results, TOOLS)
    # A result without a call has no name, no errors and isn't valid.
    name, errors, valid = F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.array_join("errors", "; "), F.lit("")).alias("errors"), F.coalesce("valid", F.lit(False)).alias("valid")
    return out.select("conv_id", "call_id", "turn", "result_turn", name, "status", "n_calls", "n_results", "release", "level", "position", "cyclic", errors, valid, "canonical_json")


QUERIES = {"op2_chat_format": op2_chat_format}
ORACLE_SQL = {
    "op2_chat_format": r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS size FROM conversations),
c AS (
  SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'reply' ELSE 'configure' END AS name, text,
    'call-' || conv_id || '-' || CASE WHEN role = 'assistant' AND turn >= 3 AND size % 7 = 0 THEN turn - 2 ELSE turn END AS call_id,
    CASE WHEN role <> 'assistant' THEN NULL WHEN size % 3 = 0 THEN 'call-' || conv_id || '-' || (turn + 2) WHEN size % 3 = 1 AND turn >= 3 THEN 'call-' || conv_id || '-' || (turn - 2) END AS after
  FROM t WHERE role IN ('assistant', 'system')),
r AS (SELECT conv_id, 'call-' || conv_id || '-' || CASE WHEN size % 5 = 0 THEN turn + 1 ELSE turn - 1 END AS call_id, turn AS result_turn, text AS content FROM t WHERE role = 'user' AND turn > 0),
a AS (SELECT *, '{' || CASE WHEN name = 'configure' THEN '' ELSE CASE WHEN after IS NULL THEN '' ELSE '"after":' || to_json('$' || after) || ',' END || '"length":' || length(text) || ',' END || '"text":' || to_json(text) || '}' AS arguments FROM c),
n AS (SELECT *, count(*) OVER w AS n_calls, row_number() OVER (w ORDER BY turn, name, text) AS k FROM a WINDOW w AS (PARTITION BY conv_id, call_id)),
one AS (SELECT * FROM n WHERE k = 1),
m AS (SELECT *, count(*) OVER w AS n_results, row_number() OVER (w ORDER BY result_turn, content) AS k FROM r WINDOW w AS (PARTITION BY conv_id, call_id)),
e AS (SELECT x.conv_id, x.call_id, x.after FROM one x JOIN one y ON y.conv_id = x.conv_id AND y.call_id = x.after WHERE x.after <> x.call_id),
reach AS (SELECT conv_id, call_id, after AS far FROM e UNION SELECT reach.conv_id, reach.call_id, e.after FROM reach JOIN e ON e.conv_id = reach.conv_id AND e.call_id = reach.far),
loops AS (SELECT conv_id, call_id FROM reach WHERE far = call_id),
bad AS (SELECT conv_id, call_id FROM loops UNION SELECT reach.conv_id, reach.call_id FROM reach JOIN loops ON loops.conv_id = reach.conv_id AND loops.call_id = reach.far),
f AS (
  SELECT x.conv_id, x.call_id, x.turn, bad.call_id IS NOT NULL AS cyclic,
    CASE WHEN bad.call_id IS NOT NULL THEN x.turn ELSE greatest(x.turn, coalesce((SELECT max(y.turn) FROM reach JOIN one y ON y.conv_id = reach.conv_id AND y.call_id = reach.far WHERE reach.conv_id = x.conv_id AND reach.call_id = x.call_id), x.turn)) END AS release
  FROM one x LEFT JOIN bad ON bad.conv_id = x.conv_id AND bad.call_id = x.call_id),
g AS (
  SELECT f.*, CASE WHEN f.cyclic THEN 0 ELSE (SELECT count(*) FROM reach JOIN f y ON y.conv_id = reach.conv_id AND y.call_id = reach.far WHERE reach.conv_id = f.conv_id AND reach.call_id = f.call_id AND y.release = f.release) END AS level FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cyclic, release, level, turn, call_id) AS position FROM g),
j AS (
  SELECT coalesce(n.conv_id, m.conv_id) AS conv_id, coalesce(n.call_id, m.call_id) AS call_id, n.turn, m.result_turn, n.name, n.arguments, m.content, n.n_calls, m.n_results,
    n.after IS NOT NULL AND (n.after = n.call_id OR NOT EXISTS (SELECT 1 FROM one x WHERE x.conv_id = n.conv_id AND x.call_id = n.after)) AS lost
  FROM one n FULL JOIN (SELECT * FROM m WHERE k = 1) m ON n.conv_id = m.conv_id AND n.call_id = m.call_id)
SELECT j.conv_id, j.call_id, coalesce(j.turn, -1) AS turn, coalesce(result_turn, -1) AS result_turn, coalesce(name, '') AS name,
  CASE WHEN n_calls IS NULL THEN 'orphan_result' WHEN n_results IS NULL THEN 'unanswered' WHEN result_turn < j.turn THEN 'result_before_call' ELSE 'linked' END AS status,
  CAST(coalesce(n_calls, 0) AS BIGINT) AS n_calls, CAST(coalesce(n_results, 0) AS BIGINT) AS n_results, coalesce(p.release, -1) AS release, CAST(coalesce(p.level, -1) AS BIGINT) AS level,
  CAST(coalesce(p.position, -1) AS BIGINT) AS position, coalesce(p.cyclic, false) AS cyclic,
  CASE WHEN n_calls IS NOT NULL AND lost THEN 'unknown reference' ELSE '' END AS errors, n_calls IS NOT NULL AND NOT lost AS valid,
  '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || to_json(j.call_id) || ',"name":' || coalesce(to_json(name), 'null') || ',"result":' || coalesce(to_json(content), 'null') || '}' AS canonical_json
FROM j LEFT JOIN p ON p.conv_id = j.conv_id AND p.call_id = j.call_id"""
}
