"""op11: near-duplicate groups of documents by two-word shingles at a similarity of 80 % or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptspread.llm import bbit_minhash
from promptspread.llm.registry import register
from promptspread.sources.tables import table

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 1), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM e JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
), g AS (
  SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
  FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = w.doc_id
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM g
"""


@register("op11_bbit_minhash", SQL)
def bbit_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.join(table(spark, sf_dir, "documents"))
