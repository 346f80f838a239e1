"""op7: all documents mixed to the sources' weights; documents of good quality come first with double weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptspread.llm import mixing
from promptspread.llm.registry import register
from promptspread.sources.tables import table


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, weight): weight 2 where a label says good, else 1."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (1 + F.coalesce("quality", F.lit(0))).cast("double").alias("weight"))


SQL = """
WITH RECURSIVE good AS (
  SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id
), d AS (
  SELECT d.doc_id, coalesce(d.source, chr(1114111)) AS src, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         -ln((CAST('0x' || substr(md5('23|' || d.doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / (1 + coalesce(good.quality, 0)) AS key
  FROM documents d LEFT JOIN good ON d.doc_id = good.doc_id
), per AS (
  SELECT src, sum(size) AS source_size FROM d GROUP BY src
), ranked AS (
  SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY src) - 1) % 3 AS INTEGER) + 1] AS w,
         2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS budget FROM per
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS l
  FROM ranked WINDOW b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT src, source_size, CAST(least(cap, w * max(l) OVER ()) AS DOUBLE) AS target FROM levels
), st AS (
  SELECT 0 AS round, doc_id, size, d.src, source_size, target, key, CASE WHEN source_size > 0 THEN floor(floor(target + 1e-6) / source_size) ELSE 0 END AS complete,
         floor(target + 1e-6) - CASE WHEN source_size > 0 THEN floor(floor(target + 1e-6) / source_size) ELSE 0 END * source_size AS missing, false AS chosen
  FROM d JOIN goal ON d.src = goal.src
  UNION ALL
  SELECT round + 1, doc_id, size, src, source_size, target, key, complete, missing - coalesce(sum(CASE WHEN now THEN size END) OVER (PARTITION BY src), 0), chosen OR now
  FROM (
    SELECT *, candidate AND sum(CASE WHEN candidate THEN size ELSE 0 END) OVER (PARTITION BY src ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= missing AS now,
           sum(CAST(candidate AS INTEGER)) OVER () AS candidates
    FROM (SELECT *, NOT chosen AND size <= missing AND missing > 0 AS candidate FROM st)
  ) WHERE candidates > 0
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (complete + CAST(chosen AS INTEGER)) AS BIGINT) AS taken
FROM st WHERE round = (SELECT max(round) FROM st)
"""


@register("op7_source_mix", SQL)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"), quality=quality(spark, sf_dir))
    rows = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
