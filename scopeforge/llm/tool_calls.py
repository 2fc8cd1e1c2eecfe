"""Tool calls and their results in chats (operator 3), in DataFrame operations only.

``link`` takes
  calls    (conv_id, turn, call_id, name, arguments: JSON, after: array of call ids)
  results  (conv_id, turn, call_id, content)
  schemas  (name, field, type, required), types as in JSON schema
  messages (conv_id, turn, role, content), turns that are neither; they keep their places
and joins calls and results by (conversation, id), orders both so that a result follows its
call and a call the results that it needs, checks arguments against the tool's fields, and
writes canonical JSON: members sorted, no white space, numbers and strings in one spelling.

Order: a message keeps its turn unless something it needs comes later; then it moves behind
that.  Moves are found by rounds over the pairs that are out of order, so chats in order
take none.  Messages on a cycle, or behind one, get the status ``cycle`` and some order;
a chat with a cycle takes up to twice as many rounds as it has messages.

Status of a call: ``invalid_json``, ``unknown_tool``, ``invalid_arguments``, ``duplicate_call``
(an id's later calls), ``no_result``, or ``ok``; of a result: ``orphan_result``,
``duplicate_result`` (later results of a call) or ``ok``.  ``problems`` names the fields.

Nulls: null arguments are invalid JSON; a null id links with nothing; null turns come first;
null content is JSON null.  Rows that repeat an id are told apart by turn, then by content;
exact repeats are all but one duplicates.  Further columns are not read.  Empty: empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopeforge.session import materialize, shared_dir

from .common import table, word_count

#: Turns whose messages are numbered together.
TURN_RUN = 256

#: Type names of variant values by the JSON schema type that they satisfy.
_FITS = {"integer": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\\(\\d+,0\\))", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)",
         "string": "^STRING", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID"}


def quoted(value: Column) -> Column:
    """A string as JSON; null as null."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substr(whole, F.lit(6), F.length(whole) - 6))


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with ``canonical`` arguments and ``problems`` against the tool's fields."""
    fields = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("field", "type", "required"))).alias("fields"))
    value = F.try_parse_json("arguments")
    found = calls.join(fields, "name", "left").withColumn("value", value)
    # members as a map from field to the type of its value
    is_object = F.schema_of_variant("value").startswith("OBJECT")
    found = found.withColumn("types", F.when(is_object, F.map_from_entries(F.transform(
        F.map_entries(F.col("value").cast("map<string,variant>")),
        lambda e: F.struct(e["key"], F.schema_of_variant(e["value"]))))))
    fits = F.lit(False)
    checks = lambda kind, have: [F.when(kind == k, have.rlike(p)) for k, p in _FITS.items()]
    wrong = F.transform("fields", lambda f: F.when(
        F.col("types")[f["field"]].isNull(), F.when(f["required"], F.concat(F.lit("missing:"), f["field"]))).when(
        ~F.coalesce(*checks(f["type"], F.col("types")[f["field"]]), fits), F.concat(F.lit("type:"), f["field"])))
    extra = F.transform(F.array_except(F.map_keys("types"), F.transform("fields", lambda f: f["field"])),
                        lambda k: F.concat(F.lit("unknown:"), k))
    problems = F.array_sort(F.array_compact(F.concat(wrong, extra)))
    return (found.withColumn("canonical", F.to_json("value"))
            .withColumn("problems", F.when(F.col("types").isNotNull() & F.col("fields").isNotNull(), problems))
            .withColumn("argument_status", F.when(F.col("types").isNull(), "invalid_json").when(
                F.col("fields").isNull(), "unknown_tool").when(F.size("problems") > 0, "invalid_arguments"))
            .drop("value", "types", "fields"))


def _moved(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, at, depth, cycle): the place of every message.  ``nodes``: (node, conv_id,
    turn); ``edges``: (conv_id, source, target).  A target's place lies behind all its
    sources.  Each round takes up only the chats in which something still moves."""
    spark = nodes.sparkSession
    sizes = nodes.groupBy("conv_id").agg(F.count("*").alias("many"))
    places = materialize(nodes.select("node", "conv_id", F.col("turn").alias("at"), F.lit(0).cast("long").alias("depth")), "tool-places")
    settled, first = f"{shared_dir(spark)}/stages/tool-settled-{uuid.uuid4().hex[:12]}", True
    while True:
        source = places.select(F.col("node").alias("source"), F.col("at").alias("s_at"), F.col("depth").alias("s_depth"))
        target = places.select(F.col("node").alias("target"), F.col("at").alias("t_at"), F.col("depth").alias("t_depth"))
        late = (edges.join(source, "source").join(target, "target")
                .filter(F.struct("s_at", "s_depth") >= F.struct("t_at", "t_depth"))
                .groupBy("conv_id", F.col("target").alias("node")).agg(F.max(F.struct("s_at", "s_depth")).alias("behind")))
        if first and late.isEmpty():
            return places.withColumn("cycle", F.lit(False))
        # a message that has moved behind as many messages as its chat holds is on a cycle or
        # behind one; its chat goes on until all of a cycle have
        late = materialize(late.join(sizes, "conv_id").filter(F.col("behind.s_depth") <= 2 * F.col("many")), "tool-late")
        moving = materialize(late.select("conv_id").distinct(), "tool-chats")
        still = places.join(moving, "conv_id", "left_anti").join(sizes.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
        still.select("node", "conv_id", "at", "depth", (F.col("depth") >= F.col("many")).alias("cycle")).write.mode("append").parquet(settled)
        if moving.isEmpty():
            return spark.read.parquet(settled)
        places = materialize(places.join(moving, "conv_id", "left_semi").join(late.select("node", "behind"), "node", "left").select(
            "node", "conv_id", F.coalesce("behind.s_at", "at").alias("at"),
            F.coalesce(F.col("behind.s_depth") + 1, "depth").alias("depth")), "tool-places")
        edges = materialize(edges.join(moving, "conv_id", "left_semi"), "tool-edges")
        first = False


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, turn, kind, call_id, status, problems, message), one row per call,
    result and plain message, ``position`` counting from 1 in each conversation."""
    calls = checked(calls.select("conv_id", "turn", "call_id", "name", "arguments", "after"), schemas)
    text = F.coalesce("canonical", quoted(F.col("arguments")))
    calls = calls.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", "after", "argument_status", "problems",
        F.concat(F.lit('{"arguments":'), text, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'),
                 quoted(F.col("name")), F.lit(',"type":"tool_call"}')).alias("message"))
    results = results.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id",
        F.lit(None).cast("array<string>").alias("after"), F.lit(None).cast("string").alias("argument_status"),
        F.lit(None).cast("array<string>").alias("problems"),
        F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"id":'), quoted(F.col("call_id")),
                 F.lit(',"type":"tool_result"}')).alias("message"))
    rows = calls.unionByName(results)
    if messages is not None:
        none = F.lit(None)
        rows = rows.unionByName(messages.select(
            "conv_id", "turn", F.lit("message").alias("kind"), none.cast("string").alias("call_id"),
            none.cast("array<string>").alias("after"), none.cast("string").alias("argument_status"),
            none.cast("array<string>").alias("problems"),
            F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"role":'), quoted(F.col("role")),
                     F.lit(',"type":"message"}')).alias("message")))
    rows = materialize(rows.withColumn("node", F.monotonically_increasing_id()), "tool-rows")

    # of each id the first call and the first result; the others are duplicates
    id_ = ["conv_id", "call_id"]
    lead = (rows.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*id_, "kind")
            .agg(F.min(F.struct("turn", "message", "node"))["node"].alias("lead")))
    call_lead = lead.filter("kind = 'call'").select(*id_, F.col("lead").alias("call_node"))
    result_lead = lead.filter("kind = 'result'").select(*id_, F.col("lead").alias("result_node"))
    pairs = materialize(call_lead.join(result_lead, id_, "full"), "tool-pairs")
    needs = (rows.filter("kind = 'call'").select("conv_id", F.explode("after").alias("call_id"), F.col("node").alias("target"))
             .join(pairs, id_).select("conv_id", F.coalesce("result_node", "call_node").alias("source"), "target"))
    edges = materialize(pairs.filter("call_node IS NOT NULL AND result_node IS NOT NULL")
                        .select("conv_id", F.col("call_node").alias("source"), F.col("result_node").alias("target")).union(needs)
                        .filter("source <> target"), "tool-edges")
    places = _moved(rows.select("node", "conv_id", F.col("turn").cast("long").alias("turn")), edges)

    status = (F.when(F.col("cycle"), "cycle").when(F.col("argument_status").isNotNull(), F.col("argument_status"))
              .when((F.col("kind") == "call") & (F.col("call_node") != F.col("node")), "duplicate_call")
              .when((F.col("kind") == "call") & F.col("result_node").isNull(), "no_result")
              .when((F.col("kind") == "result") & F.col("call_node").isNull(), "orphan_result")
              .when((F.col("kind") == "result") & (F.col("result_node") != F.col("node")), "duplicate_result")
              .otherwise("ok"))
    ready = (rows.join(pairs, id_, "left").join(places.select("node", "at", "depth", "cycle"), "node")
             .withColumn("status", status).withColumn("run", F.floor(F.coalesce("at", F.lit(-1)) / TURN_RUN)))
    # numbering in runs of turns, so that a long conversation is many tasks' work
    before = (ready.groupBy("conv_id", "run").count().withColumn("before", F.sum("count").over(
        Window.partitionBy("conv_id").orderBy("run")) - F.col("count"))
        .select(F.col("conv_id").alias("c"), F.col("run").alias("r"), "before"))
    own = F.row_number().over(Window.partitionBy("conv_id", "run").orderBy(
        "at", "depth", "kind", "turn", "call_id", "message", "node"))
    return (ready.withColumn("own", own).join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
            .select("conv_id", (F.col("before") + F.col("own")).cast("long").alias("position"), "turn", "kind", "call_id",
                    "status", F.array_join("problems", ",").alias("problems"), "message"))


#: The tool of the query below.
ASK = [("ask", "text", "string", True), ("ask", "words", "integer", True), ("ask", "urgent", "boolean", False)]


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool use: a user turn calls ``ask`` with its text and number of
    words (as a string where there are fewer than four, which the schema refuses) and needs
    the answer to the user turn before; an assistant or tool turn answers the turn before it;
    turns of any other role, or of none, are plain messages."""
    chats = table(spark, sf_dir, "conversations")
    n = word_count("text")
    number = F.when(n < 4, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n.cast("string"))
    body = F.to_json(F.struct("text"))
    calls = chats.filter("role = 'user'").select(
        "conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("call_id"), F.lit("ask").alias("name"),
        F.concat(F.lit('{ "words" : '), number, F.lit(" , "), F.substr(body, F.lit(2))).alias("arguments"),
        F.array(F.concat_ws(":", "conv_id", F.col("turn") - 2)).alias("after"))
    results = chats.filter("role IN ('assistant', 'tool')").select(
        "conv_id", "turn", F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame(ASK, "name string, field string, type string, required boolean")
    others = chats.filter("role IS NULL OR role NOT IN ('user', 'assistant', 'tool')").select(
        "conv_id", "turn", "role", F.col("text").alias("content"))
    return link(calls, results, schemas, others)


ORACLE = r"""
WITH m AS (SELECT conv_id, turn, role, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM conversations),
c AS (SELECT conv_id, turn, 'call' AS kind, conv_id || ':' || turn AS call_id, n < 4 AS bad,
        '{"arguments":{"text":' || to_json(text) || ',"words":' || CASE WHEN n < 4 THEN '"' || n || '"' ELSE n::VARCHAR END
        || '},"id":"' || conv_id || ':' || turn || '","name":"ask","type":"tool_call"}' AS message FROM m WHERE role = 'user'),
r AS (SELECT conv_id, turn, 'result' AS kind, conv_id || ':' || (turn - 1) AS call_id,
        '{"content":' || to_json(text) || ',"id":"' || conv_id || ':' || (turn - 1) || '","type":"tool_result"}' AS message
      FROM m WHERE role IN ('assistant', 'tool')),
a AS (SELECT c.conv_id, c.turn, c.kind, c.call_id, CASE WHEN bad THEN 'invalid_arguments' WHEN r.call_id IS NULL THEN 'no_result'
        ELSE 'ok' END AS status, CASE WHEN bad THEN 'type:words' ELSE '' END AS problems, c.message
      FROM c LEFT JOIN r USING (call_id)
      UNION ALL
      SELECT r.conv_id, r.turn, r.kind, r.call_id, CASE WHEN c.call_id IS NULL THEN 'orphan_result' ELSE 'ok' END, NULL, r.message
      FROM r LEFT JOIN c USING (call_id)
      UNION ALL
      SELECT conv_id, turn, 'message', NULL, 'ok', NULL, '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":'
        || coalesce(to_json(role)::VARCHAR, 'null') || ',"type":"message"}'
      FROM m WHERE role IS NULL OR role NOT IN ('user', 'assistant', 'tool'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kind)::BIGINT AS position, turn, kind, call_id, status,
       problems, message FROM a
"""
