"""File sources and sinks (A1-A13): task JSON, JSONL, CSV, split and result tables, fingerprints.

Readers take explicit schemas (no inference pass over large inputs).  Sinks
write partitioned Parquet / JSON / CSV with dynamic partition overwrite, so a
re-run replaces only the partitions it produces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK_SCHEMA = T.StructType([
    T.StructField("Definition", T.ArrayType(T.StringType())),
    T.StructField("Instances", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.ArrayType(T.StringType()))]))),
])
INDUCTION_SCHEMA = T.StructType([
    T.StructField("annotations", T.ArrayType(T.StringType())),
    T.StructField("examples", T.MapType(T.StringType(), T.StructType([
        T.StructField("input", T.StringType()), T.StructField("output", T.StringType())]))),
])
TURN = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A1: task JSON files (one object per file) -> instances(task, instance_id, input, output, definition).

    The task name is the file name without extension; ``posexplode`` keeps the
    position of each instance as its id.
    """
    raw = (spark.read.schema(TASK_SCHEMA).option("multiLine", True).json(path)
           .withColumn("task", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)))
    return raw.select("task", F.element_at("Definition", 1).alias("definition"),
                      F.posexplode("Instances").alias("instance_id", "inst")).select(
        "task", F.col("instance_id").cast("bigint"), F.col("inst.input").alias("input"),
        F.col("inst.output").alias("output"), "definition")


def pick_task_file(spark: SparkSession, path: str, name_part: str) -> DataFrame:
    """A2: task files whose name contains ``name_part`` with a check that exactly one matches.

    Only file metadata is read (``binaryFile`` with the content column pruned).
    """
    files = spark.read.format("binaryFile").load(path).select(
        F.col("path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"))
    hits = files.where(F.col("file_name").contains(name_part))
    # the matching file list is tiny (a name filter over one folder): a global window is fine here
    return hits.withColumn("n_matches", F.count(F.lit(1)).over(Window.partitionBy())) \
        .withColumn("unique", F.col("n_matches") == 1)


def read_induction(spark: SparkSession, path: str) -> DataFrame:
    """A3 input: map-shaped examples -> (task, example_key, input, output) plus the annotations."""
    raw = (spark.read.schema(INDUCTION_SCHEMA).option("multiLine", True).json(path)
           .withColumn("task", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)))
    ex = raw.select("task", F.explode("examples").alias("example_key", "ex"))
    return ex.select("task", "example_key", F.col("ex.input").alias("input"), F.array(F.col("ex.output")).alias("output"))


def read_conversation_csv(spark: SparkSession, path: str, column: str = "conversations") -> tuple[DataFrame, DataFrame]:
    """A5: CSV whose column holds a list literal of turns -> (parsed rows, rejects).

    Python-literal lists use single quotes; ``allowSingleQuotes`` parses them as
    JSON.  Rows that still fail go to the reject table instead of failing the job.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    opts = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}
    parsed = raw.withColumn("turns", F.from_json(F.col(column), T.ArrayType(TURN), opts))
    return parsed.where(F.col("turns").isNotNull()), parsed.where(F.col("turns").isNull())


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str = "none") -> None:
    """JSON Lines sink (one record per line), optional partition columns and compression."""
    w = df.write.mode("overwrite").option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON Lines source with an explicit schema."""
    return spark.read.schema(schema).json(path)


def write_partitioned(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Partitioned Parquet with dynamic partition overwrite (re-runs replace their partitions)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def scan_results(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Result files under ``root`` matching ``glob`` in any sub-folder, with their file name."""
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).parquet(root)
            .withColumn("file_name", F.col("_metadata.file_name")))


def write_csv(df: DataFrame, path: str) -> None:
    """A10: CSV with a header line."""
    # RFC 4180 quoting: a quote inside a field is doubled, backslashes are plain characters
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def file_digests(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(rel, md5 of the file's bytes) for every file below ``root``, one row each, computed where the file is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root))
    after = F.instr("path", root.rstrip("/")) + len(root.rstrip("/"))
    return files.select(F.col("path").substr(after, F.length("path")).alias("rel"), F.md5("content").alias("h"))


def fingerprint(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Number of files and the md5 of the files' md5 digests in path order (one row).

    Contents are digested where they are read; what meets in one place is 16 bytes
    and a name per file.  Spark's readers skip empty files, so these don't count.
    """
    listed = F.sort_array(F.collect_list(F.struct("rel", F.unhex("h").alias("b"))))
    joined = F.aggregate(listed, F.lit("").cast("binary"), lambda out, x: F.concat(out, x["b"]))
    return file_digests(spark, root, glob).agg(F.count(F.lit(1)).alias("n_files"), F.md5(joined).alias("fingerprint"))


def turn_literal(speaker, value):
    """One turn as a single-quoted dict literal (backslash, quote and newline escaped)."""
    esc = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")),
                    F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit("{'from': '"), speaker, F.lit("', 'value': '"), esc, F.lit("'}"))
