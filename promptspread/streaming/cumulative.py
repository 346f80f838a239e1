"""Structured Streaming form of cumulative accuracy (E17) over the ``events`` stream.

Each event is one evaluated row of one arm (arm = user_id % 20, success = a
non-error event whose value exceeds the arm id - the V7 rule).  The running
totals are a stateful streaming aggregate with one state row per (arm, block):
there are few arms, and a block is a share of an arm's events, so an arm that
holds most of them is updated by many tasks.  State lives in the checkpoint
folder, so a restarted or re-scheduled query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from promptspread.session import shared_path

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
N_ARMS = 20
BLOCKS = 16   # state rows of an arm


def outcome_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """The events table read as a stream of outcome rows (arm, ok, ts)."""
    ev = (spark.readStream.format("parquet").schema(EVENTS_SCHEMA)
          .option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", max_files).load(sf_dir))
    arm = F.col("user_id") % N_ARMS
    return ev.select(arm.alias("arm"), F.pmod(F.xxhash64("event_id"), F.lit(BLOCKS)).alias("block"), "ts",
                     F.when((F.col("event_type") != "error") & (F.col("value") > arm), 1).otherwise(0).alias("ok"))


def running_accuracy(outcomes: DataFrame) -> DataFrame:
    """Per (arm, block): rows seen and successes so far."""
    return outcomes.groupBy("arm", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("s"))


def totals(state: DataFrame) -> DataFrame:
    """Per arm, from the state rows of its blocks: rows seen, successes, accuracy so far."""
    return state.groupBy("arm").agg(F.sum("n").alias("cum_total"), F.sum("s").alias("cum_successes")).withColumn("cum_accuracy", F.col("cum_successes") / F.col("cum_total"))


def start_running_accuracy(spark: SparkSession, sf_dir: str, query_name: str,
                           checkpoint: str | None = None) -> StreamingQuery:
    """Run the stream until its input is drained; the state rows are an in-memory table for ``totals`` (tests, notebooks)."""
    checkpoint = checkpoint or shared_path(spark, f"stream/{query_name}")
    agg = running_accuracy(outcome_stream(spark, sf_dir))
    return (agg.writeStream.outputMode("complete").format("memory").queryName(query_name)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
