"""op9: pages archived as WARC records and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptspread.llm import warc
from promptspread.llm.common import fresh_path
from promptspread.llm.registry import register
from promptspread.sources.tables import table

# base32 of the 40 hex digits: five bits of the 160 at a time
SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), g AS (
  SELECT sha, max(page_id) AS last FROM p GROUP BY sha
), b AS (
  SELECT sha, last, list_aggregate(list_transform(range(1, 41), lambda i:
    lpad(bin(instr('0123456789abcdef', substr(sha, CAST(i AS INTEGER), 1)) - 1), 4, '0')), 'string_agg', '') AS bits FROM g
), d AS (
  SELECT sha, last, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(list_aggregate(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER) * (16 >> j)), 'sum') AS INTEGER) + 1, 1)),
    'string_agg', '') AS payload_digest FROM b
)
SELECT p.page_id, p.payload_bytes, d.payload_digest,
       CASE WHEN d.last IS NULL OR p.page_id = d.last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> d.last OR p.page_id IS NULL THEN d.last END AS refers_to
FROM p JOIN d ON p.sha = d.sha
"""


def page_of(record_id: str):
    """The page id in ``urn:page:<page_id>:<digest>:<copy>``."""
    return F.try_element_at(F.split(F.col(record_id), ":"), F.lit(3)).try_cast("long")


@register("op9_warc", SQL)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    back = warc.read(spark, path)
    return back.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))
