"""The register of format texts."""

from pyspark.sql import functions as F

from promptspread.plans import QUERIES
from promptspread.plans import format_queries as FQ


def test_register_is_drawn_once(spark, tmp_path):
    spark.range(30).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    x = QUERIES["c23_register_formats"](spark, str(tmp_path))
    assert x.where("format_id >= 0").count() == FQ.valid_texts(spark, str(tmp_path)).count() > 0
    assert "aggregate(" not in x._jdf.queryExecution().optimizedPlan().toString()   # draws are read from the stored register
