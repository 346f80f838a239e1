"""Derived model-output views (FIXTURES.md §3) over the driver tables.

Model inference is outside this engine; its outputs arrive as tables.  The
driver tables hold none, so the views below derive them by integer arithmetic
that Spark and DuckDB evaluate identically.  Each view exists twice: a Spark
DataFrame builder (used by the queries) and a DuckDB SQL text (used by the
oracle SQL as a CTE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptspread.functions.ranking import bucketed_rank, hashed_rank
from promptspread.sources.tables import table


# ---------------------------------------------------------------- Spark side

def predictions(spark: SparkSession, d: str) -> DataFrame:
    """V1: (task, instance_id, format_id, answer, generation); 2 tasks x 10 formats."""
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    x = (lab.select("*", F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("task"))
         .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("format_id")))
    answer = F.when(F.col("task") == "quality", F.col("quality")).otherwise(F.col("toxic"))
    hit = (F.col("doc_id") * 7919 + F.col("format_id") * 104729) % 100 < 60 + 4 * ((F.col("format_id") * 7) % 10)
    return x.select(
        "task", F.col("doc_id").alias("instance_id"), "format_id", answer.alias("answer"),
        F.when(hit, answer).otherwise(((F.col("doc_id") + F.col("format_id")) % 3).cast("int")).alias("generation"))


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    """V2: (instance_id, format_id, class, score, answer); 6 formats x 10 classes."""
    emb = table(spark, d, "embeddings")
    x = emb.select("vec_id", "label", F.posexplode("embedding").alias("pos", "x")).where("pos < 60")
    return x.select(F.col("vec_id").alias("instance_id"),
                    F.floor(F.col("pos") / 10).cast("int").alias("format_id"),
                    (F.col("pos") % 10).cast("int").alias("class"),
                    F.col("x").cast("double").alias("score"),
                    F.col("label").alias("answer"))


def token_scores(spark: SparkSession, d: str) -> DataFrame:
    """V3: 3 formats x 10 classes x 2 trailing positions."""
    cs = class_scores(spark, d)
    return cs.select("instance_id", F.floor(F.col("format_id") / 2).cast("int").alias("format_id"), "class",
                     (1 - F.col("format_id") % 2).alias("pos_from_end"),
                     (1 + F.col("class") % 2).alias("answer_length"),
                     F.col("score").alias("logprob"), "answer")


def text_generations(spark: SparkSession, d: str) -> DataFrame:
    """V4: dirty generated text per (instance, variant)."""
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    x = lab.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("variant"))
    q1 = F.col("quality") == 1
    gen = (F.when(F.col("variant") == 0, F.concat(F.lit(" ("), F.when(q1, "B").otherwise("A"), F.lit(")")))
           .when(F.col("variant") == 1,
                 F.when(F.col("doc_id") % 4 == 0, F.lit("article"))
                 .otherwise(F.concat(F.when(F.col("toxic") == 1, "a").otherwise("b"), F.lit(". because"))))
           .when(F.col("variant") == 2,
                 F.when(F.col("doc_id") % 5 == 0, F.lit(""))
                 .otherwise(F.concat(F.lit("<"), (1 + F.col("quality")).cast("string"), F.lit(">"))))
           .when(F.col("variant") == 3,
                 F.when(F.col("doc_id") % 3 == 0, F.lit("ii"))
                 .when(F.col("doc_id") % 3 == 1, F.lit("Ⅱ")).otherwise(F.lit("I")))
           .otherwise(F.when(F.col("doc_id") % 2 == 0, F.lit("b\na")).otherwise(F.lit("A ) "))))
    return x.select(F.col("doc_id").alias("instance_id"), "variant",
                    F.when(q1, "b").otherwise("a").alias("answer"), gen.alias("generation"))


def instances_base(spark: SparkSession, d: str) -> DataFrame:
    """V5 without the permutation: one projection of one scan, for all that need no order."""
    return table(spark, d, "documents").select(F.col("source").alias("task"), F.col("doc_id").alias("instance_id"),
                                               F.col("text").alias("input"), F.col("lang").alias("answer"))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return instances_base(spark, d).withColumn("__k", F.md5(F.concat(F.lit("23|"), F.col("instance_id").cast("string"))))


def instance_heads(spark: SparkSession, d: str, n: int) -> tuple[DataFrame, DataFrame]:
    """V5 in two parts that need no place of the other rows: (heads, rest).

    ``heads`` (task, instance_id, input, answer, ord) has each task's first ``n``
    places, and those after them with the n-th place's key (rows with one id share a
    key); ``rest`` (the same without ord) all later ones.  Keys alone tell where a
    task is cut, one row a task, so the texts of the rest are never shuffled.  As in
    V5, rows without an id take the first places but no part.
    """
    docs = _keyed(spark, d)
    place = F.row_number().over(Window.partitionBy("task").orderBy("__k"))
    first = docs.select("task", "__k", place.alias("__rn")).where(F.col("__rn") <= n)
    cut = first.groupBy("task").agg(F.max("__k").alias("__last"), F.count_if(F.col("__k").isNull()).alias("__nulls"))
    marked = docs.where(F.col("__k").isNotNull()).join(F.broadcast(cut), "task")
    ord_ = F.row_number().over(Window.partitionBy("task").orderBy("__k", "input", "answer")) - 1 + F.col("__nulls")
    columns = ["task", "instance_id", "input", "answer"]
    return (marked.where(F.col("__k") <= F.col("__last")).select(*columns, ord_.cast("bigint").alias("ord")),
            marked.where(F.col("__last").isNull() | (F.col("__k") > F.col("__last"))).select(*columns))


def instances(spark: SparkSession, d: str) -> DataFrame:
    """V5: (task, instance_id, input, answer, ord); ord = md5-seeded permutation within task."""
    docs = _keyed(spark, d)
    ranked = hashed_rank(docs, ["task"], "__k", out_col="__rn")
    return ranked.select("task", "instance_id", "input", "answer",
                         (F.col("__rn") - 1).cast("bigint").alias("ord"))


def conversation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """V6: first two user/assistant turns of each conversation, user then assistant.

    ``row_number() <= 2`` lets Spark insert a partial window group limit before
    the shuffle, so even a huge conversation ships at most two rows per task.
    """
    conv = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    first2 = conv.withColumn("__rn", F.row_number().over(w)).where("__rn <= 2")
    pairs = first2.groupBy("conv_id").agg(
        F.max(F.when((F.col("__rn") == 1) & (F.col("role") == "user"), F.col("text"))).alias("user_text"),
        F.max(F.when((F.col("__rn") == 2) & (F.col("role") == "assistant"), F.col("text"))).alias("assistant_text"))
    return pairs.where(F.col("user_text").isNotNull() & F.col("assistant_text").isNotNull())


def arm_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """V7: per-arm evaluation log (arm, ord, batch_no, ok) from events.

    Only 20 arms: a plain per-arm window would run on 20 tasks however large
    ``events`` grows, so the order is numbered per (arm, hour) bucket.
    """
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    arm = F.col("user_id") % 20
    x = ev.select(arm.alias("arm"), "ts", "event_id",
                  F.when((F.col("event_type") != "error") & (F.col("value") > arm), 1).otherwise(0).alias("ok"))
    x = bucketed_rank(x, ["arm"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts")), out_col="__rn")
    ord_ = (F.col("__rn") - 1).cast("bigint")
    return x.select("arm", ord_.alias("ord"), F.floor(ord_ / 20).cast("bigint").alias("batch_no"), "ok")


def task_records(spark: SparkSession, d: str) -> DataFrame:
    """V8: roll-up input (model, method, setting, task, n, median_accuracy, spread_accuracy)."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    g = c.select(
        F.concat(F.lit("M"), (F.col("c_nationkey") % 4).cast("string")).alias("model"),
        F.col("c_mktsegment").alias("method"),
        F.when(F.col("c_nationkey") % 2 == 0, "uniform").otherwise("compositional").alias("setting"),
        F.concat(F.lit("task"), (F.col("c_custkey") % 13).cast("string")).alias("task"),
        ((F.col("c_custkey") * 37) % 1001).alias("a"), ((F.col("c_custkey") * 37) % 101).alias("b"))
    return g.groupBy("model", "method", "setting", "task").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("a").cast("double") / (1000 * F.count(F.lit(1)))).alias("median_accuracy"),
        ((F.max("b") - F.min("b")).cast("double") / 100).alias("spread_accuracy"))


SPARK_VIEWS = {
    "predictions": predictions, "class_scores": class_scores, "token_scores": token_scores,
    "text_generations": text_generations, "instances": instances,
    "conversation_pairs": conversation_pairs, "arm_outcomes": arm_outcomes,
    "task_records": task_records,
}


# --------------------------------------------------------------- DuckDB side

SQL_VIEWS = {
    "predictions": """
SELECT t.task, l.doc_id AS instance_id, CAST(f.format_id AS BIGINT) AS format_id,
       CASE WHEN t.task = 'quality' THEN l.quality ELSE l.toxic END AS answer,
       CASE WHEN (l.doc_id * 7919 + f.format_id * 104729) % 100 < 60 + 4 * ((f.format_id * 7) % 10)
            THEN CASE WHEN t.task = 'quality' THEN l.quality ELSE l.toxic END
            ELSE CAST((l.doc_id + f.format_id) % 3 AS INT) END AS generation
FROM labels l
CROSS JOIN (SELECT 0 AS format_id UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4
            UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9) f
CROSS JOIN (SELECT 'quality' AS task UNION ALL SELECT 'toxic') t""",
    "class_scores": """
SELECT vec_id AS instance_id, CAST(floor((i - 1) / 10) AS INT) AS format_id, CAST((i - 1) % 10 AS INT) AS class,
       CAST(embedding[i] AS DOUBLE) AS score, label AS answer
FROM embeddings, range(1, 61) r(i)""",
    "token_scores": """
SELECT instance_id, CAST(floor(format_id / 2) AS INT) AS format_id, class,
       1 - format_id % 2 AS pos_from_end, 1 + class % 2 AS answer_length, score AS logprob, answer
FROM class_scores""",
    "text_generations": """
SELECT l.doc_id AS instance_id, v.variant, CASE WHEN l.quality = 1 THEN 'b' ELSE 'a' END AS answer,
       CASE v.variant
         WHEN 0 THEN concat(' (', CASE WHEN l.quality = 1 THEN 'B' ELSE 'A' END, ')')
         WHEN 1 THEN CASE WHEN l.doc_id % 4 = 0 THEN 'article' ELSE concat(CASE WHEN l.toxic = 1 THEN 'a' ELSE 'b' END, '. because') END
         WHEN 2 THEN CASE WHEN l.doc_id % 5 = 0 THEN '' ELSE concat('<', CAST(1 + l.quality AS VARCHAR(4)), '>') END
         WHEN 3 THEN CASE l.doc_id % 3 WHEN 0 THEN 'ii' WHEN 1 THEN 'Ⅱ' ELSE 'I' END
         ELSE CASE WHEN l.doc_id % 2 = 0 THEN concat('b', chr(10), 'a') ELSE 'A ) ' END END AS generation
FROM labels l
CROSS JOIN (SELECT 0 AS variant UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) v""",
    "instances": """
SELECT task, instance_id, input, answer, CAST(rn0 - 1 AS BIGINT) AS ord
FROM (SELECT source AS task, doc_id AS instance_id, text AS input, lang AS answer,
             row_number() OVER (PARTITION BY source ORDER BY md5(concat('23|', CAST(doc_id AS VARCHAR(20))))) AS rn0
      FROM documents) d""",
    "conversation_pairs": """
SELECT a.conv_id, a.text AS user_text, b.text AS assistant_text
FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
      FROM conversations WHERE role IN ('user', 'assistant')) a
JOIN (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
      FROM conversations WHERE role IN ('user', 'assistant')) b
  ON a.conv_id = b.conv_id AND a.rn = 1 AND b.rn = 2 AND a.role = 'user' AND b.role = 'assistant'""",
    "arm_outcomes": """
SELECT arm, CAST(ord AS BIGINT) AS ord, CAST(floor(ord / 20) AS BIGINT) AS batch_no, ok
FROM (SELECT user_id % 20 AS arm, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) - 1 AS ord,
             CASE WHEN event_type <> 'error' AND value > (user_id % 20) THEN 1 ELSE 0 END AS ok
      FROM events) e""",
    "task_records": """
SELECT concat('M', CAST(c.c_nationkey % 4 AS VARCHAR(4))) AS model, c.c_mktsegment AS method,
       CASE WHEN c.c_nationkey % 2 = 0 THEN 'uniform' ELSE 'compositional' END AS setting,
       concat('task', CAST(c.c_custkey % 13 AS VARCHAR(4))) AS task,
       count(*) AS n, CAST(sum((c.c_custkey * 37) % 1001) AS DOUBLE) / (1000 * count(*)) AS median_accuracy,
       CAST(max((c.c_custkey * 37) % 101) - min((c.c_custkey * 37) % 101) AS DOUBLE) / 100 AS spread_accuracy
FROM customer c
GROUP BY c.c_nationkey % 4, c.c_mktsegment, CASE WHEN c.c_nationkey % 2 = 0 THEN 'uniform' ELSE 'compositional' END, c.c_custkey % 13""",
}

_DEPENDS = {"token_scores": ["class_scores"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the DuckDB CTEs of the named views (and their inputs)."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in _DEPENDS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]}\n)" for n in order)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
