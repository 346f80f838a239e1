"""op12: embeddings in whitened coordinates along the 32 leading components of their covariance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptspread.llm import whitening
from promptspread.llm.registry import register
from promptspread.sources.tables import table


@register("op12_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
