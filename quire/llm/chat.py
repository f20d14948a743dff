"""Chat formatting (1): tool calls linked to their results, in topological order, as canonical JSON.

Native: DataFrame functions only. Calls and results meet by a hash join on their identifier, which is unique, so a hot
conversation isn't one task's. The level of a call is the length of the longest chain of calls before it; forests
are solved by pointer doubling (as many joins as the logarithm of the depth), other graphs by peeling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import shared_dir, table, written

#: Argument schemas of the calls that the conversations table makes: type and least length or value of each required argument.
SCHEMAS = {
    "ask": {"prompt": ("STRING", 1), "turn": ("BIGINT", 0)},
    "configure": {"prompt": ("STRING", 1), "turn": ("BIGINT", 0)},
}


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """id, level for each id of ``calls``; ``edges`` holds id and parent. A call on or behind a cycle has a null level.

    Edges from or to ids that aren't calls, and repeated ones, don't count.
    """
    ids = calls.select("id").filter("id is not null").distinct()
    known = edges.select("id", "parent").distinct().join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("parent")), "parent", "left_semi")
    known = written(known.select("id", "parent"))
    most = known.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    return _by_doubling(ids, known) if most <= 1 else _by_peeling(ids, known)


def _by_doubling(ids: DataFrame, known: DataFrame) -> DataFrame:
    state = ids.join(known, "id", "left").select("id", F.col("parent").alias("above"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level"))
    state, n, reach = written(state), None, 1
    while not state.filter("above is not null").isEmpty():
        n = n or state.count()
        if reach > n:  # no chain is that long: what still has something above it hangs on a cycle
            return state.select("id", F.when(F.col("above").isNull(), F.col("level")).alias("level"))
        up = state.select(F.col("id").alias("above"), F.col("above").alias("_above"), F.col("level").alias("_level"))
        state = written(state.join(up, "above", "left").select("id", F.col("_above").alias("above"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")))
        reach *= 2
    return state.select("id", "level")


def _by_peeling(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Level by level, over the edges that are still open; each level's calls are written once, and all are read together at the end."""
    spark, folder = ids.sparkSession, shared_dir(ids.sparkSession)
    read = lambda path: spark.read.schema(ids.schema).parquet(path)
    ids.join(known, "id", "left_anti").write.parquet(f"{folder}/level=0")
    level, left = 0, known
    while True:
        ready = read(f"{folder}/level={level}")
        if ready.isEmpty():
            done = spark.read.schema("id string, level long").option("basePath", folder).parquet(folder)
            return ids.join(done, "id", "left").select("id", "level")
        before, left = left, written(left.join(ready.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "parent"))
        level += 1
        before.select("id").distinct().join(left.select("id"), "id", "left_anti").write.parquet(f"{folder}/level={level}")


def problems(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, int]]] = SCHEMAS) -> Column:
    """What is wrong with the arguments, joined by '; ', empty if nothing: an unknown call, no JSON object, a missing
    or unknown argument, a wrong type, or one that is too short or too small."""
    parsed = F.try_parse_json(arguments)
    kind = F.schema_of_variant(parsed)
    out = F.lit("unknown call")
    for call, schema in schemas.items():
        found = []
        for field, (wanted, least) in schema.items():
            at = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            value = F.try_variant_get(parsed, f"$.{field}", "string")
            size = F.length(value) if wanted == "STRING" else value.cast("double")
            found.append(F.when(at.isNull(), f"{field} is missing").when(at != wanted, f"{field} is not {wanted}").when(size < least, f"{field} is below {least}"))
        keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
        extra = F.array_except(keys, F.array(*[F.lit(x) for x in schema]))
        found.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), ","))))
        one = F.when(parsed.isNull() | ~kind.startswith("OBJECT"), "no JSON object").otherwise(F.concat_ws("; ", *found))
        out = F.when(name == call, one).otherwise(out)
    return out


def canonical(record: Column) -> Column:
    """JSON without white space, keys in order (a variant keeps them sorted), nulls written."""
    return F.to_json(F.parse_json(F.to_json(record, {"ignoreNullFields": "false"})))


def link_calls(calls: DataFrame, results: DataFrame, edges: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """A row for each call: id, name, level, problems, results (how many), json.

    calls: id, name, arguments (JSON text); results: id, content; edges: id, parent (a call that has to come first). Of calls that
    repeat an id the least (name, arguments) counts, of several results the least content; calls without id are kept, unlinked.
    A call on a cycle has a null level and the problem 'cycle'. No calls give no rows; results without a call are dropped.
    """
    named = calls.filter("id is not null").groupBy("id").agg(F.min(F.struct("name", "arguments")).alias("_c")).select("id", "_c.*")
    single = written(named.unionByName(calls.filter("id is null").select("id", "name", "arguments")))
    answers = results.filter("id is not null").groupBy("id").agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("results"))
    out = single.hint("shuffle_hash").join(answers, "id", "left").join(levels(single, edges), "id", "left")
    cycle = F.col("id").isNotNull() & F.col("level").isNull()
    wrong = F.concat_ws("; ", F.when(cycle, "cycle"), F.nullif(problems(F.col("name"), F.col("arguments"), schemas), F.lit("")))
    out = out.withColumn("problems", wrong).withColumn("results", F.coalesce("results", F.lit(0).cast("long")))
    parsed = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.col("arguments"))
    record = F.struct(
        parsed.alias("arguments"), F.col("id"), F.col("level"), F.col("name"), F.col("content").alias("result"), (F.col("problems") == "").alias("valid"))
    return out.select("id", "name", "level", "problems", "results", canonical(record).alias("json"))


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and edges of a table of turns.

    A user's or system's turn is a call, named ask or configure, with the text as its prompt; its identifier is conversation and turn.
    The assistant's next turn holds its result. A call follows the latest call among the two turns before it. So that there is something to find, the first
    hex digit of the md5 of a call's identifier spoils some, one way for each digit: 0 arguments cut short, 1 the turn as text, 2 no prompt, 3 an argument
    too many, 4 an unknown name. Calls without identifier stay as they are.
    """
    role = F.col("role")
    ident = lambda turn: F.concat_ws(":", F.when(F.col("turn").isNotNull(), F.col("conv_id").cast("string")), turn.cast("string"))
    own = lambda turn: F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), ident(turn))
    asked = conversations.filter(role.isin("user", "system"))
    prompt, turn = F.coalesce("text", F.lit("")).alias("prompt"), F.col("turn")
    spoilt = F.substring(F.md5(own(turn)), 1, 1)
    arguments = F.to_json(F.struct(prompt, turn))
    arguments = (F.when(spoilt == "0", F.concat(F.lit('{"turn":'), turn.cast("string"))).when(spoilt == "1", F.to_json(F.struct(prompt, turn.cast("string").alias("turn"))))
                 .when(spoilt == "2", F.to_json(F.struct(turn))).when(spoilt == "3", F.to_json(F.struct(prompt, turn, F.lit(True).alias("urgent")))).otherwise(arguments))
    name = F.when(spoilt == "4", "guess").when(role == "user", "ask").otherwise("configure")
    calls = asked.select(own(turn).alias("id"), name.alias("name"), arguments.alias("arguments"))
    answered = conversations.filter(role == "assistant")
    results = answered.select(own(F.col("turn") - 1).alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    turns = asked.select("conv_id", "turn").filter("conv_id is not null and turn is not null").distinct()
    before = turns.select("conv_id", F.col("turn").alias("_before"), F.explode(F.array(F.col("turn") + 1, F.col("turn") + 2)).alias("turn"))
    pairs = turns.join(before, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.max("_before").alias("_before"))
    edges = pairs.select(ident(F.col("turn")).alias("id"), ident(F.col("_before")).alias("parent"))
    return calls, results, edges


def op1_tool_calls(spark, sf_dir: str) -> DataFrame:
    return link_calls(*from_conversations(table(spark, sf_dir, "conversations")))


OP1_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS id, md5(conv_id || ':' || turn)[1] AS spoilt,
         CASE WHEN md5(conv_id || ':' || turn)[1] = '4' THEN 'guess' WHEN role = 'user' THEN 'ask' ELSE 'configure' END AS name, coalesce(text, '') AS prompt
  FROM conversations WHERE role IN ('user', 'system')),
results AS (SELECT conv_id || ':' || (turn - 1) AS id, min(coalesce(text, '')) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1),
parents AS (
  SELECT a.id, max_by(b.id, b.turn) AS parent FROM calls a JOIN calls b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2) GROUP BY a.id),
lv(id, level) AS (
  SELECT id, 0::BIGINT FROM calls WHERE id NOT IN (SELECT id FROM parents)
  UNION ALL SELECT p.id, lv.level + 1 FROM parents p JOIN lv ON p.parent = lv.id),
checked AS (
  SELECT *, CASE spoilt WHEN '4' THEN 'unknown call' WHEN '0' THEN 'no JSON object' WHEN '2' THEN 'prompt is missing'
    ELSE concat_ws('; ', CASE WHEN length(prompt) < 1 THEN 'prompt is below 1' END, CASE spoilt WHEN '1' THEN 'turn is not BIGINT' WHEN '3' THEN 'unknown: urgent' END) END AS problems,
    CASE spoilt WHEN '0' THEN '{"turn":' || turn WHEN '1' THEN json_object('prompt', prompt, 'turn', turn::VARCHAR)::VARCHAR WHEN '2' THEN json_object('turn', turn)::VARCHAR
      WHEN '3' THEN json_object('prompt', prompt, 'turn', turn, 'urgent', true)::VARCHAR ELSE json_object('prompt', prompt, 'turn', turn)::VARCHAR END AS arguments
  FROM calls)
SELECT c.id, c.name, lv.level, c.problems, coalesce(r.n, 0)::BIGINT AS results,
       json_object('arguments', c.arguments, 'id', c.id, 'level', lv.level, 'name', c.name, 'result', r.content, 'valid', c.problems = '')::VARCHAR AS json
FROM checked c JOIN lv ON c.id = lv.id LEFT JOIN results r ON c.id = r.id
"""
