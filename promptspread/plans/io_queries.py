"""Queries A6-A16: sinks and sources round-tripped through the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptspread.functions.ranking import bucketed_rank
from promptspread.operators import format_space as S
from promptspread.operators import instances as I
from promptspread.operators import metrics as M
from promptspread.operators import prompts as P
from promptspread.plans import format_queries as FQ
from promptspread.plans import instance_queries as IQ
from promptspread.plans import prompt_queries as PQ
from promptspread.plans.metrics_queries import KEYS, TASK_RECORD_SQL
from promptspread.plans.registry import register
from promptspread.session import shared_path
from promptspread.sources import files as IO
from promptspread.sources import results as R
from promptspread.sources import views as V
from promptspread.sources.tables import table

MODEL = "model-under-test"
TEMPERATURE = 0.0
# Fixed values (must equal the reference): defaults of a batch request.
MAX_TOKENS = 4
TOP_LOGPROBS = 5
REQUEST_SEED = 24
EXPECTED_FORMATS = 12


def _dir(spark, name):
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir on a cluster)."""
    return shared_path(spark, f"io/{name}-{uuid.uuid4().hex[:12]}")


@register("a6_jsonl_roundtrip", views=("instances",), sql="SELECT task, instance_id, answer FROM instances")
def a6_jsonl_roundtrip(spark, d):
    """Write instances as JSON Lines and read them back with an explicit schema."""
    path = _dir(spark, "jsonl")
    IO.write_jsonl(V.instances_base(spark, d).select("task", "instance_id", "answer"), path)
    return IO.read_jsonl(spark, path, "task string, instance_id bigint, answer string")


@register("a7_split_files", views=("instances",), sql=f"""{FQ.SPLIT_SQL},
ord AS (SELECT DISTINCT tl.task, d.doc_id AS instance_id, row_number() OVER (PARTITION BY tl.task ORDER BY md5(concat_ws('|', '31', CAST(d.doc_id AS VARCHAR)))) - 1 AS ord
  FROM tl JOIN documents d ON regexp_replace(tl.task, '^task[0-9]+_', '') = concat_ws('_', d.source, d.lang))
SELECT mode, task, 'test' AS kind, CAST(ord - 1 AS BIGINT) AS ord, vals AS names, kinds AS action_types, CAST(NULL AS BIGINT) AS instance_id FROM split
UNION ALL SELECT m.mode, ord.task, 'id', CAST(ord.ord AS BIGINT), NULL, NULL, ord.instance_id FROM ord, (SELECT DISTINCT mode FROM split) m""")
def a7_split_files(spark, d):
    """The split documents of all modes (test formats, action types, order of the instances), written and read back."""
    path = _dir(spark, "splits")
    formats = FQ.split(spark, d).select("mode", "task", "ord", S.names(F.col("codes")).alias("names"), S.slot_kinds().alias("kinds"))
    inst = IQ.layout_instances(spark, d).select("task", "instance_id")
    R.write_splits(formats, I.seeded_shuffle(inst, ["task"], "instance_id", 31), path)
    back = R.read_splits(spark, path)
    return back.select("mode", "task", "kind", "ord", F.array_join("names", "\x1f").alias("names"), F.array_join("action_types", ",").alias("action_types"), "instance_id")


EXPERIMENT = "model-under-test---2-shot"


def result_logs(spark, d):
    """Stand-in prediction logs: the predictions view, its formats under texts of one layout."""
    ids = V.predictions(spark, d).select("format_id").distinct().withColumn("number", F.lit(S.NAMES.index(FQ.F36_LAYOUT)))
    text = S.evaluated(S.drawn(ids, "results")).select("format_id", S.rendered(F.col("cells")).alias("format_text"))
    return V.predictions(spark, d).join(F.broadcast(text), "format_id").withColumn("experiment", F.lit(EXPERIMENT))   # ten formats


@register("a8_result_sink", views=("predictions",), sql="""
SELECT p.task, p.format_id, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN generation = answer THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(CASE WHEN generation <> answer AND c.class IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS wrong
FROM predictions p LEFT JOIN (SELECT DISTINCT task, answer AS class FROM predictions) c ON c.task = p.task AND c.class = p.generation GROUP BY p.task, p.format_id""")
def a8_result_sink(spark, d):
    """Result documents (generation order, accuracies, prediction logs) written, one task's parts written again, accuracies read back."""
    path = _dir(spark, "results")
    logs = result_logs(spark, d)
    R.write_results(logs, path)
    again = logs.agg(F.max("task")).scalar()
    R.write_results(logs.where(F.col("task") == again), path)   # a re-run replaces its own documents only
    acc = R.accuracies(R.scan(spark, path, r"\.json$"))
    return acc.select("task", "format_id", "n", F.col("right").alias("accuracy"), "wrong")


@register("a9_result_scan", views=("predictions",), sql=TASK_RECORD_SQL)
def a9_result_scan(spark, d):
    """Result documents found by name pattern in all experiment folders, and the task records of the logs in them."""
    root = _dir(spark, "experiments")
    R.write_results(result_logs(spark, d), root)
    logged = R.predictions(R.scan(spark, root, r"^metadataholistic_.*\.json$"))
    typed = logged.select("task", "format_id", "instance_id", F.col("answer").cast("int").alias("answer"), F.col("generation").cast("int").alias("generation"))
    return M.task_record(M.format_metrics(typed, KEYS), ["task"])


TR_SCHEMA = "model string, method string, setting string, task string, n bigint, median_accuracy double, spread_accuracy double"


@register("a10_csv_roundtrip", views=("task_records",), sql="""
SELECT model, method, setting, task, CAST(n AS BIGINT) AS n, round(median_accuracy, 6) AS median_accuracy,
       round(spread_accuracy, 6) AS spread_accuracy FROM task_records""")
def a10_csv_roundtrip(spark, d):
    """A10: task records to CSV with a header and back with a schema."""
    path = _dir(spark, "csv")
    IO.write_csv(V.task_records(spark, d), path)
    return IO.read_csv(spark, path, TR_SCHEMA)


@register("a11_directory_fingerprint", views=("predictions",))
def a11_directory_fingerprint(spark, d):
    """Content fingerprint of a result folder: the digest of its files' digests in path order."""
    path = _dir(spark, "fp")
    R.write_results(result_logs(spark, d), path)
    return IO.fingerprint(spark, path, "*.txt")


UNIT = ["task", "format_id"]
UNIT_MD5 = "md5(concat_ws(chr(31), CAST(answer AS VARCHAR), CAST(generation AS VARCHAR), CAST(instance_id AS VARCHAR)))"


@register("a12_resume_status", views=("predictions",), sql=f"""
WITH units AS (
  SELECT task, format_id, answer, CASE WHEN format_id = 3 THEN answer ELSE generation END AS generation, instance_id FROM predictions WHERE format_id <> 5 AND NOT (format_id = 6 AND instance_id % 2 = 0)
  UNION ALL SELECT task, format_id, answer, generation, instance_id FROM predictions WHERE format_id = 9),
now AS (SELECT task, format_id, count(*) AS n, concat_ws('-', CAST(sum(CAST('0x' || substr({UNIT_MD5}, 1, 12) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr({UNIT_MD5}, 13, 12) AS BIGINT)) AS VARCHAR)) AS digest
  FROM units GROUP BY task, format_id),
man AS (SELECT task, format_id, concat_ws('-', CAST(sum(CAST('0x' || substr({UNIT_MD5}, 1, 12) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr({UNIT_MD5}, 13, 12) AS BIGINT)) AS VARCHAR)) AS digest
  FROM predictions WHERE format_id <> 8 GROUP BY task, format_id),
planned AS (SELECT t.task, CAST(f.format_id AS BIGINT) AS format_id, e.expected
            FROM (SELECT DISTINCT task FROM predictions) t, range(0, {EXPECTED_FORMATS}) f(format_id), (SELECT CAST(count(*) AS BIGINT) AS expected FROM labels) e)
SELECT p.task, p.format_id, p.expected, CAST(coalesce(now.n, 0) AS BIGINT) AS n,
       CASE WHEN now.n IS NULL THEN 'todo' WHEN now.n > p.expected THEN 'error' WHEN now.n < p.expected OR man.digest IS NULL THEN 'resume'
            WHEN man.digest <> now.digest THEN 'redo' ELSE 'done' END AS status
FROM planned p LEFT JOIN now ON now.task = p.task AND now.format_id = p.format_id LEFT JOIN man ON man.task = p.task AND man.format_id = p.format_id""")
def a12_resume_status(spark, d):
    """Planned (task, format) units against their results and the manifest: done, resume, redo after a change, error, todo."""
    path = _dir(spark, "manifest")
    preds = V.predictions(spark, d)
    R.commit(spark, preds.where(F.col("format_id") != 8), UNIT, path)
    manifest = spark.read.parquet(f"{path}/manifest")
    # what happened since: 3 changed, 5 lost, 6 half lost, 8 written without a record, 9 written twice
    later = preds.where((F.col("format_id") != 5) & ~((F.col("format_id") == 6) & (F.col("instance_id") % 2 == 0)))
    later = later.withColumn("generation", F.when(F.col("format_id") == 3, F.col("answer")).otherwise(F.col("generation"))).unionByName(preds.where(F.col("format_id") == 9))
    expected = table(spark, d, "labels").agg(F.count(F.lit(1))).scalar()   # scalar subquery
    planned = (preds.select("task").distinct().select("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(EXPECTED_FORMATS - 1).cast("bigint"))).alias("format_id"))
               .withColumn("expected", expected))
    return R.status(planned, later, manifest, UNIT)


@register("a13_emit_prompts", views=("instances",), sql=f"""
WITH {PQ.PROMPTS_SQL}
SELECT task, format_id, CAST(count(*) AS BIGINT) AS n_prompts, CAST(sum(length(prompt)) AS BIGINT) AS n_chars
FROM prompts GROUP BY task, format_id""")
def a13_emit_prompts(spark, d):
    """Rendered prompts and answers written per (task, format) as JSON Lines, read back."""
    path = _dir(spark, "prompts")
    IO.write_jsonl(PQ.prompts(spark, d).select("task", "format_id", "instance_id", "prompt", "answer"), path,
                   ["task", "format_id"], compression="gzip")   # every line repeats its format's demonstrations
    back = spark.read.schema("instance_id bigint, prompt string, answer string, task string, format_id bigint").json(path)
    return back.groupBy("task", "format_id").agg(F.count(F.lit(1)).alias("n_prompts"),
                                                 F.sum(F.length("prompt")).alias("n_chars"))


MSG = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
REQUEST = T.StructType([
    T.StructField("custom_id", T.StringType()), T.StructField("method", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("body", T.StructType([T.StructField("model", T.StringType()), T.StructField("temperature", T.DoubleType()),
                                        T.StructField("max_tokens", T.IntegerType()), T.StructField("logprobs", T.BooleanType()),
                                        T.StructField("top_logprobs", T.IntegerType()), T.StructField("seed", T.IntegerType()),
                                        T.StructField("messages", T.ArrayType(MSG))]))])


def requests(spark, d):
    p = PQ.prompts(spark, d)
    cid = F.concat_ws("-", F.col("task"), F.col("format_id").cast("string"), F.col("instance_id").cast("string"))
    body = F.struct(F.lit(MODEL).alias("model"), F.lit(TEMPERATURE).alias("temperature"), F.lit(MAX_TOKENS).alias("max_tokens"),
                    F.lit(True).alias("logprobs"), F.lit(TOP_LOGPROBS).alias("top_logprobs"), F.lit(REQUEST_SEED).alias("seed"),
                    P.to_messages(F.col("prompt")).alias("messages"))
    req = F.struct(cid.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"),
                   body.alias("body"))
    return p.select(cid.alias("custom_id"), F.to_json(req).alias("request"))


@register("a14_api_requests", views=("instances",), sql=f"""
WITH {PQ.PROMPTS_SQL},
parts AS (SELECT *, string_split(prompt, chr(10) || chr(10)) AS ps FROM prompts)
SELECT concat_ws('-', task, CAST(format_id AS VARCHAR), CAST(instance_id AS VARCHAR)) AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, '{MODEL}' AS model,
       CAST({TEMPERATURE} AS DOUBLE) AS temperature, CAST({MAX_TOKENS} AS INT) AS max_tokens, TRUE AS logprobs, CAST({TOP_LOGPROBS} AS INT) AS top_logprobs, CAST({REQUEST_SEED} AS INT) AS seed,
       'system,user' AS roles, md5(ps[1] || {PQ.q(P.SYSTEM_SUFFIX)}) AS system_md5,
       md5(array_to_string(ps[2:len(ps) - 1], chr(10) || chr(10)) || chr(10) || chr(10) || ps[len(ps)]) AS user_md5
FROM parts""")
def a14_api_requests(spark, d):
    """One JSON request line per prompt (custom_id, method, url, whole body with messages); parsed back to check."""
    r = requests(spark, d).withColumn("r", F.from_json("request", REQUEST)).select("r.custom_id", "r.method", "r.url", "r.body.*")
    message = lambda i: F.md5(F.col("messages")[i]["content"])
    return r.select("custom_id", "method", "url", "model", "temperature", "max_tokens", "logprobs", "top_logprobs", "seed",
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), message(0).alias("system_md5"), message(1).alias("user_md5"))


RESPONSE = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([T.StructField("body", T.StructType([
        T.StructField("choices", T.ArrayType(T.StructType([T.StructField("message", MSG)])))]))]))])


@register("a15_api_responses", views=("text_generations",), sql="""
SELECT concat(CAST(instance_id AS VARCHAR), '-', CAST(variant AS VARCHAR)) AS custom_id, generation AS content, answer
FROM text_generations""")
def a15_api_responses(spark, d):
    """Response lines -> generation text (choices[0].message.content), joined to answers on custom_id."""
    t = V.text_generations(spark, d)
    cid = F.concat(F.col("instance_id").cast("string"), F.lit("-"), F.col("variant").cast("string"))
    resp = t.select(F.to_json(F.struct(cid.alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.struct(
        F.lit("assistant").alias("role"), F.col("generation").alias("content")).alias("message"))).alias("choices"))
        .alias("body")).alias("response"))).alias("line"))
    parsed = resp.select(F.from_json("line", RESPONSE).alias("r")).select(
        F.col("r.custom_id").alias("custom_id"), F.col("r.response.body.choices")[0]["message"]["content"].alias("content"))
    answers = t.select(cid.alias("custom_id"), "answer")
    return parsed.join(answers, "custom_id")


@register("a16_batch_status_counts", sql="""
SELECT event_type AS status, CAST(count(*) AS BIGINT) AS n_jobs FROM events GROUP BY event_type""")
def a16_batch_status_counts(spark, d):
    """Jobs per status (the events' type plays the batch status)."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n_jobs"))


CHUNK = 1000   # instances per task-file object (bounds every collected group)


def write_task_files(spark, d, path):
    """Task files in the reference's schema, one JSON object per (task, chunk of CHUNK instances)."""
    inst = V.instances(spark, d).withColumn("chunk", F.floor(F.col("ord") / CHUNK))
    obj = inst.groupBy("task", "chunk").agg(
        F.array(F.concat(F.lit("Identify the language of each "), F.col("task"), F.lit(" text."))).alias("Definition"),
        F.sort_array(F.collect_list(F.struct(F.col("ord"), F.col("instance_id").cast("string").alias("id"),
                                             F.col("input"), F.array(F.col("answer")).alias("output")))).alias("__i"))
    obj = obj.select("task", "chunk", "Definition",
                     F.transform("__i", lambda s: F.struct(s["id"].alias("id"), s["input"].alias("input"),
                                                           s["output"].alias("output"))).alias("Instances"))
    obj.write.mode("overwrite").partitionBy("task").json(path)


@register("a1_task_files", views=("instances",), sql="SELECT task, CAST(instance_id AS BIGINT) AS instance_id, answer FROM instances")
def a1_task_files(spark, d):
    """A1: task files (Definition + Instances[]) written in bounded chunks and scanned back with an explicit
    schema; instances exploded with their position."""
    path = _dir(spark, "tasks")
    write_task_files(spark, d, path)
    schema = T.StructType(IO.TASK_SCHEMA.fields + [T.StructField("chunk", T.LongType()), T.StructField("task", T.StringType())])
    raw = spark.read.schema(schema).json(path)
    x = raw.select("task", F.posexplode("Instances").alias("pos", "inst"))
    return x.select("task", F.col("inst.id").cast("bigint").alias("instance_id"), F.col("inst.output")[0].alias("answer"))


NAME_PARTS = ["src1", "src10", "src10_"]


@register("a2_pick_task_file", views=("instances",), sql=f"""
WITH t AS (SELECT DISTINCT task FROM instances),
p AS (SELECT * FROM (VALUES {", ".join(f"('{n}')" for n in NAME_PARTS)}) v(name_part))
SELECT p.name_part, CAST(count(t.task) AS BIGINT) AS n_matches, count(t.task) = 1 AS unique_match,
       CASE WHEN count(t.task) = 1 THEN min(t.task) END AS picked
FROM p LEFT JOIN t ON contains(concat('task=', t.task), p.name_part) GROUP BY p.name_part""")
def a2_pick_task_file(spark, d):
    """A2: pick the task folder by a name substring and require exactly one match (the reference asserts it)."""
    path = _dir(spark, "pick")
    V.instances_base(spark, d).select("task", "instance_id").write.mode("overwrite").partitionBy("task").parquet(path)
    folders = (spark.read.parquet(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"/(task=[^/]+)/", 1)
                                               .alias("folder")).distinct())
    parts = []
    for n in NAME_PARTS:
        hit = folders.where(F.col("folder").contains(n))
        parts.append(hit.agg(F.count(F.lit(1)).alias("n_matches"), F.min("folder").alias("f")).select(
            F.lit(n).alias("name_part"), "n_matches", (F.col("n_matches") == 1).alias("unique_match"),
            F.when(F.col("n_matches") == 1, F.regexp_replace("f", "^task=", "")).alias("picked")))
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), parts)


TURN_CHUNK = 64   # turns per CSV cell (bounds every collected group)
SPEAKER = {"user": "human", "assistant": "gpt"}


@register("a5_conversation_csv", sql=f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
k AS (SELECT *, place // {TURN_CHUNK} AS chunk, conv_id % 10 = 7 AND place // {TURN_CHUNK} = 0 AS broken FROM c)
SELECT conv_id, CAST(place AS BIGINT) AS place, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS speaker, md5(text) AS value_md5, FALSE AS rejected FROM k WHERE NOT broken
UNION ALL SELECT DISTINCT conv_id, chunk * {TURN_CHUNK}, NULL, NULL, TRUE FROM k WHERE broken""")
def a5_conversation_csv(spark, d):
    """A5: conversations as a CSV column of list literals of turns (64 turns per cell), parsed back; cells that are no list
    literal (here those of some conversations, whose closing bracket is missing) are rows of their own."""
    path = _dir(spark, "conv_csv")
    c = bucketed_rank(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.floor(F.col("turn") / TURN_CHUNK), "rn")
    speaker = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SPEAKER.items() for x in kv]), F.col("role")), F.col("role"))
    cells = (c.withColumn("chunk", F.floor((F.col("rn") - 1) / TURN_CHUNK))
             .groupBy("conv_id", "chunk")
             .agg(F.sort_array(F.collect_list(F.struct("rn", IO.turn_literal(speaker, F.col("text")).alias("lit")))).alias("t")))
    literal = F.concat(F.lit("["), F.array_join(F.transform("t", lambda x: x["lit"]), ", "), F.when((F.col("conv_id") % 10 == 7) & (F.col("chunk") == 0), "").otherwise("]"))
    IO.write_csv(cells.select("conv_id", "chunk", literal.alias("conversations")), path)
    ok, rejects = IO.read_conversation_csv(spark, path)
    start = F.col("chunk").cast("bigint") * TURN_CHUNK
    x = ok.select(F.col("conv_id").cast("bigint").alias("conv_id"), start.alias("start"), F.posexplode("turns").alias("pos", "t"))
    good = x.select("conv_id", (F.col("start") + F.col("pos")).alias("place"), F.col("t.from").alias("speaker"), F.md5(F.col("t.value")).alias("value_md5"), F.lit(False).alias("rejected"))
    none = F.lit(None).cast("string")
    return good.unionByName(rejects.select(F.col("conv_id").cast("bigint").alias("conv_id"), start.alias("place"), none.alias("speaker"), none.alias("value_md5"), F.lit(True).alias("rejected")))
