"""Result documents, split documents and the manifest of finished work.

A result document is the JSON object an evaluation run leaves behind: the order in
which formats were generated, their accuracies (right share, wrong share, rows) and
the log of every prediction, all keyed by the format's text.  The keys are open, so
documents are read as VARIANT and their maps exploded.  A task's log can be larger
than a document should be; it is therefore written in parts of ``PART`` instances,
each a complete document of its own, and every scan puts the parts together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = 1000   # instances of a task in one document


def _text(value: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _object(pairs: Column) -> Column:
    """A JSON object from an array of ``key: value`` texts."""
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def write_results(logs: DataFrame, path: str) -> None:
    """Rows (experiment, task, format_id, format_text, instance_id, answer, generation) as result documents, one
    folder per experiment and file name; only the parts that the rows hold are replaced."""
    right = F.coalesce(F.col("generation") == F.col("answer"), F.lit(False)).cast("double")
    classes = logs.select("experiment", "task", F.col("answer").alias("class")).distinct().withColumn("known", F.lit(1.0))
    flagged = logs.join(classes, (logs["experiment"] == classes["experiment"]) & (logs["task"] == classes["task"]) & (logs["generation"] == classes["class"]), "left").select(
        logs["*"], right.alias("right"), (F.coalesce("known", F.lit(0.0)) - right).alias("wrong"))
    each = flagged.groupBy("experiment", "task", "format_id", "format_text").agg(F.avg("right").alias("r"), F.avg("wrong").alias("w"), F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct("format_id", F.concat(_text(F.col("format_text")), F.lit(":"), F.col("format_id").cast("string")).alias("o"),
                                                 F.concat(_text(F.col("format_text")), F.lit(":"), F.to_json(F.array("r", "w", F.col("n").cast("double")))).alias("a"))))
    heads = each.groupBy("experiment", "task").agg(order.alias("h"))   # one entry per format of a task
    entry = F.to_json(F.struct(F.col("instance_id").alias("dataset_idx"), F.col("answer").cast("string").alias("answer"), F.col("generation").cast("string").alias("generation")))
    part = F.floor(F.col("instance_id") / PART).alias("part")
    nodes = logs.groupBy("experiment", "task", part, "format_id", "format_text").agg(F.sort_array(F.collect_list(F.struct("instance_id", entry.alias("e")))).alias("es"))
    node = F.concat(_text(F.col("format_text")), F.lit(":[["), F.col("format_id").cast("string"), F.lit("],["), F.array_join(F.transform("es", lambda e: e["e"]), ","), F.lit("]]"))
    bodies = nodes.groupBy("experiment", "task", "part").agg(F.sort_array(F.collect_list(F.struct("format_id", node.alias("n")))).alias("ns"))
    doc = F.concat(F.lit('{"generation_order":'), _object(F.transform("h", lambda h: h["o"])), F.lit(',"edges":[],"all_structured_prompt_formats_accuracies":'),
                   _object(F.transform("h", lambda h: h["a"])), F.lit(',"metadata":{"nodes":'), _object(F.transform("ns", lambda n: n["n"])), F.lit("}}"))
    name = F.concat(F.lit("metadataholistic_"), F.col("task"), F.lit("_part"), F.col("part").cast("string"), F.lit(".json"))
    docs = bodies.join(heads, ["experiment", "task"]).select("experiment", name.alias("file"), doc.alias("value")).repartition("experiment", "file")
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "file").text(path)


def scan(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(experiment, file, task, v) of all documents below ``path`` whose file name matches the pattern; the task
    comes from the name (F15)."""
    raw = spark.read.schema("value string, experiment string, file string").text(path).where(F.col("file").rlike(pattern))
    task = F.regexp_extract("file", r"^metadataholistic_(.*)_part\d+\.json$", 1)
    return raw.select("experiment", "file", task.alias("task"), F.parse_json("value").alias("v"))


def exploded(rows: DataFrame, value: Column, key: str, out: str) -> DataFrame:
    """Rows once for each key of a VARIANT object (or place of an array), with the key and its value."""
    each = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(value))
    return each.select(*rows.columns, F.col("key" if key != "pos" else "pos").alias(key), F.col("value").alias(out))


def accuracies(docs: DataFrame) -> DataFrame:
    """(experiment, task, format_id, format_text, right, wrong, n): the accuracies that documents record, parts put together."""
    at = lambda path: F.variant_get(F.col("v").outer(), path, "variant")
    acc = exploded(docs.select("experiment", "task", "v"), at("$.all_structured_prompt_formats_accuracies"), "format_text", "a").drop("v")
    order = exploded(docs.select("experiment", "task", "v"), at("$.generation_order"), "format_text", "o").drop("v")
    number = lambda i: F.variant_get("a", f"$[{i}]", "double")
    acc = acc.select("experiment", "task", "format_text", number(0).alias("right"), number(1).alias("wrong"), number(2).cast("bigint").alias("n")).distinct()
    order = order.select("experiment", "task", "format_text", F.variant_get("o", "$", "bigint").alias("format_id")).distinct()
    return acc.join(order, ["experiment", "task", "format_text"])


def predictions(docs: DataFrame) -> DataFrame:
    """(experiment, task, format_id, instance_id, answer, generation): every logged prediction of the documents."""
    nodes = exploded(docs.select("experiment", "task", "v"), F.variant_get(F.col("v").outer(), "$.metadata.nodes", "variant"), "format_text", "node").drop("v")
    entries = exploded(nodes, F.variant_get(F.col("node").outer(), "$[1]", "variant"), "pos", "entry")
    get = lambda field, kind: F.variant_get("entry", f"$.{field}", kind)
    return entries.select("experiment", "task", F.variant_get("node", "$[0][0]", "bigint").alias("format_id"), get("dataset_idx", "bigint").alias("instance_id"),
                          get("answer", "string").alias("answer"), get("generation", "string").alias("generation"))


# ------------------------------------------------------------------ split files

def write_splits(formats: DataFrame, order: DataFrame, path: str) -> None:
    """Split documents from (mode, task, ord, names, kinds) and (task, ord, instance_id); a task's instance order is
    written in parts of ``PART`` places, its formats in the first one."""
    tests = formats.groupBy("mode", "task").agg(F.sort_array(F.collect_list(F.struct("ord", "names"))).alias("f"), F.first("kinds").alias("action_types"))   # formats of one split
    parts = order.groupBy("task", F.floor(F.col("ord") / PART).alias("part")).agg(F.sort_array(F.collect_list(F.struct("ord", "instance_id"))).alias("ids"))
    none = F.array().cast("array<array<string>>")
    doc = F.to_json(F.struct(none.alias("train_formats"), none.alias("val_formats"), F.when(F.col("part") == 0, F.transform("f", lambda x: x["names"])).otherwise(none).alias("test_formats"),
                             "action_types", F.transform("ids", lambda x: x["instance_id"]).alias("dataset_ordered_ids")))
    name = F.concat(F.lit("holistic_random_sample_"), F.col("task"), F.lit("_part"), F.col("part").cast("string"), F.lit(".json"))
    docs = tests.join(parts, "task").select("mode", name.alias("file"), doc.alias("value")).repartition("mode", "file")
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode", "file").text(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(mode, task, kind, ord, names, action_types, instance_id): the formats and the places of every split document."""
    schema = "train_formats array<array<string>>, val_formats array<array<string>>, test_formats array<array<string>>, action_types array<string>, dataset_ordered_ids array<bigint>"
    raw = spark.read.schema("value string, mode string, file string").text(path)
    name = r"^holistic_random_sample_(.*)_part(\d+)\.json$"
    docs = raw.select("mode", F.regexp_extract("file", name, 1).alias("task"), F.regexp_extract("file", name, 2).cast("bigint").alias("part"), F.from_json("value", schema).alias("d")).select("mode", "task", "part", "d.*")
    kinds = [docs.select("mode", "task", F.lit(k[:-8]).alias("kind"), F.posexplode(k).alias("ord", "names"), "action_types") for k in ("train_formats", "val_formats", "test_formats")]
    ids = docs.select("mode", "task", F.lit("id").alias("kind"), "part", F.posexplode("dataset_ordered_ids").alias("pos", "instance_id"))
    formats = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).select("mode", "task", "kind", F.col("ord").cast("bigint").alias("ord"), "names", "action_types", F.lit(None).cast("bigint").alias("instance_id"))
    none = F.lit(None).cast("array<string>")
    return formats.unionByName(ids.select("mode", "task", "kind", (F.col("part") * PART + F.col("pos")).alias("ord"), none.alias("names"), none.alias("action_types"), "instance_id"))


# --------------------------------------------------------------------- manifest

def digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, digest): number of rows and a digest of each unit's content that no order changes."""
    rest = sorted(c for c in rows.columns if c not in keys)
    own = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rest]))
    half = lambda at: F.conv(F.substring(own, at, 12), 16, 10).cast("bigint")

    def total(x):   # of numbers of 48 bits, whose sum a bigint would not hold: by their upper and lower 24 bits
        upper, lower = F.sum(F.shiftright(x, 24)), F.sum(x.bitwiseAND(F.lit((1 << 24) - 1)))
        return upper.cast("decimal(20,0)") * F.lit(1 << 24).cast("decimal(8,0)") + lower.cast("decimal(20,0)")

    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.concat_ws("-", *[total(half(at)).cast("string") for at in (1, 13)]).alias("digest"))


def commit(spark: SparkSession, rows: DataFrame, keys: list[str], path: str) -> None:
    """Write the units' rows, then their digests as read back; a unit without a record of its own is not done."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/units")
    written = rows.select(*keys).distinct()
    back = spark.read.schema(rows.select(*[c for c in rows.columns if c not in keys], *keys).schema).parquet(f"{path}/units")
    digests(back.join(written, keys, "left_semi"), keys).write.mode("append").parquet(f"{path}/manifest")


def status(planned: DataFrame, units: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected, n, status) for every planned unit: todo without rows, error with too many, resume with too few
    or without a record, redo if its content is not what was recorded, else done."""
    now = digests(units, keys)
    # a unit that was committed again has several records; any that fits its content counts
    fits = now.join(manifest.select(*keys, F.col("n").alias("m"), F.col("digest").alias("recorded")), keys, "left")
    fits = fits.groupBy(*keys, "n").agg(F.bool_or(F.col("recorded").isNotNull()).alias("known"), F.coalesce(F.bool_or(F.col("recorded") == F.col("digest")), F.lit(False)).alias("same"))
    x = planned.join(fits, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = (F.when(F.col("n") == 0, "todo").when(F.col("n") > F.col("expected"), "error").when((F.col("n") < F.col("expected")) | ~F.col("known"), "resume")
             .when(~F.col("same"), "redo").otherwise("done"))
    return x.select(*keys, "expected", "n", state.alias("status"))
