"""op13: periodic runs of words in every document, a tenth of which is first made periodic from some word on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptspread.llm import periodic
from promptspread.llm.common import WORD_PATTERN
from promptspread.llm.registry import register
from promptspread.sources.tables import table

# crc32 bit by bit; equal words at most a quarter of a text apart, and islands of them, give the runs
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, k + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
  FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substr(s, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM crc WHERE k < 8 * length(s))
), h AS (
  SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) AS h FROM crc WHERE k = 8 * length(s)
), w AS (
  SELECT d.doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, h FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id
), v AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g FROM w))
), t AS (
  SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS word, n
  FROM (SELECT *, unnest(range(0, n)) AS i FROM v)
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= 4 * q AND length >= 6 GROUP BY doc_id, start, length
), per_doc AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM runs GROUP BY doc_id
), best AS (
  SELECT doc_id, start, length, period, 1000 * length // period AS exponent_milli
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS r FROM runs) WHERE r = 1
), kept AS (
  SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256
  FROM t WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM w LEFT JOIN per_doc USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def repeated_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents whose id's crc32 is divisible by 10 repeat a stretch of their words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.col("text"), F.lit(WORD_PATTERN), F.lit(0)))
    rows = docs.select("doc_id", "text", h.alias("h")).select("doc_id", "text", "h", words.alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    once = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(once, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    changed = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


@register("op13_periodic_runs", SQL)
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.detect(repeated_ends(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    runs = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("strongest")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"), F.sha2(runs, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
