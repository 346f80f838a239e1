"""op10: repeated and nearly repeated lines of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptspread.llm import line_dedup
from promptspread.llm.registry import register
from promptspread.sources.tables import table

SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, i - 1 AS no, ls[i] AS line FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), u AS (
  SELECT line, min((doc_id, no)) AS start, count(*) AS n FROM l WHERE length(line) >= {line_dedup.LEAST} GROUP BY line
), e AS (
  SELECT a.line AS x, b.line AS y FROM u a JOIN (SELECT line, unnest(range(length(line) - {line_dedup.EDITS}, length(line) + {line_dedup.EDITS + 1})) AS n FROM u) b
  ON length(a.line) = b.n AND a.line <> b.line AND levenshtein(a.line, b.line) <= {line_dedup.EDITS}
), o AS (
  SELECT 0 AS round, x AS p, y AS q FROM e WHERE md5(x) < md5(y)
  UNION ALL
  SELECT round + 1, p, q FROM o WHERE p NOT IN (SELECT i.q FROM o i WHERE i.p NOT IN (SELECT j.q FROM o j))
    AND q NOT IN (SELECT i.q FROM o i WHERE i.p NOT IN (SELECT j.q FROM o j))
), near AS (
  SELECT DISTINCT o.q AS line FROM o WHERE o.p NOT IN (SELECT i.q FROM o i WHERE i.round = o.round)
), r AS (
  SELECT line AS x, line AS y FROM u UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
), c AS (
  SELECT r.x AS line, min(u.start) AS class, sum(u.n) AS n FROM r JOIN u ON u.line = r.y GROUP BY r.x
), d AS (
  SELECT x AS line, count(*) AS links FROM e GROUP BY x
), f AS (
  SELECT l.doc_id, l.no, c.class, c.n, coalesce(d.links, 0) AS links, near.line IS NOT NULL OR u.start <> (l.doc_id, l.no) AS gone
  FROM l LEFT JOIN u ON u.line = l.line LEFT JOIN c ON c.line = l.line LEFT JOIN d ON d.line = l.line LEFT JOIN near ON near.line = l.line
)
SELECT t.doc_id, count(f.no) AS n_lines, count(*) FILTER (gone) AS n_dropped, CAST(coalesce(sum(links), 0) AS BIGINT) AS n_links,
       coalesce(string_agg(CASE WHEN gone THEN CAST(no AS VARCHAR) END, ',' ORDER BY no), '') AS dropped,
       coalesce(string_agg(CASE WHEN n > 1 THEN concat(no, '=', class[1], ':', class[2]) END, ',' ORDER BY no), '') AS classes
FROM documents t LEFT JOIN f ON f.doc_id = t.doc_id GROUP BY t.doc_id
"""


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, which of them go, their links to different lines, and the class of every line that
    is not alone in its class, as ``line number = document : line number`` of the class's first line."""
    lines, edges = line_dedup.classes(docs)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    gone = F.when(~F.col("kept"), F.col("no"))
    group = F.when(F.col("n") > 1, F.struct("no", F.concat(F.col("no").cast("string"), F.lit("="), F.coalesce(F.col("class.id").cast("string"), F.lit("")), F.lit(":"), F.col("class.no").cast("string")).alias("c")))
    # every copy of a row that occurs several times has a line 0, or, if its text is null, one row
    per = lines.join(degree, "a", "left").groupBy("id", "h").agg(
        F.count(F.when(F.coalesce("no", F.lit(0)) == 0, 1)).alias("copies"), F.count("no").alias("lines"), F.sum("links").alias("links"),
        F.sort_array(F.collect_set(gone)).alias("gone"), F.sort_array(F.collect_set(group)).alias("groups"))
    each = lambda c: F.expr(f"coalesce({c}, 0) div copies")
    per = per.select("id", "copies", each("lines").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), each("links").alias("n_links"),
                     F.array_join("gone", ",").alias("dropped"), F.array_join(F.transform("groups", lambda g: g["c"]), ",").alias("classes"))
    rows = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", "n_links", "dropped", "classes")


@register("op10_line_dedup", SQL)
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"))
