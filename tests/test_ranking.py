"""Skew-safe ranks equal plain row_number, including one hot group holding most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from promptspread.functions.ranking import bucketed_rank, hashed_rank, seeded_key


def test_hashed_rank_equals_row_number(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("g"),
                                  F.col("id"))
    df = df.withColumn("k", seeded_key(3, F.col("id")))
    got = hashed_rank(df, ["g"], "k", out_col="rn", prefix_chars=2)
    want = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    diff = got.join(want, ["g", "id"]).where(F.col("rn") != F.col("rn2")).count()
    assert diff == 0 and got.count() == 5000


def test_bucketed_rank_time_buckets(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 1000).alias("t"), "id")
    got = bucketed_rank(df, ["g"], ["t", "id"], F.floor(F.col("t") / 100), out_col="rn")
    want = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")))
    assert got.join(want, ["g", "id"]).where(F.col("rn") != F.col("rn2")).count() == 0
