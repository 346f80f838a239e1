"""op5: secrets in every document, with the parts of credentials that complete each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptspread.llm import secrets
from promptspread.llm.registry import register
from promptspread.sources.tables import table

BASE = ("assign", "access", "hex")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame, paragraphs: bool = False) -> DataFrame:
    found = secrets.spans(docs, paragraphs=paragraphs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        F.col("id").alias("doc_id"),
        *[count_of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@register("op5_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), paragraphs=True)
