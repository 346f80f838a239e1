"""op4: the ten highest inner products for every hundredth vector, against all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptspread.llm import topk
from promptspread.llm.registry import register
from promptspread.sources.tables import table

SQL = """
WITH flat AS (
  SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE embedding IS NOT NULL)
), bad AS (
  SELECT DISTINCT vec_id FROM flat WHERE x IS NULL OR NOT isfinite(x)
), v AS (
  SELECT vec_id, i, CAST(floor(1024 * x) AS BIGINT) AS w FROM flat WHERE vec_id NOT IN (SELECT vec_id FROM bad)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
  GROUP BY q.vec_id, c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""


@register("op4_exact_topk", SQL)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), topk.quantised(F.col("embedding")))
