"""Format splits (C13-C17): reference-task formats carried to every task, kept where they are valid on all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptspread.operators import format_space as S
from promptspread.operators import layouts as L

ATTEMPTS = 10   # valid reference formats looked at, per test format asked for


def everywhere(reference: DataFrame) -> DataFrame:
    """Every reference-task assignment (codes, any keys) carried to every layout, with its validity there."""
    rows = reference.drop("template", "mode", "number", "cells", "rejected", "valid")
    return S.evaluated(S.with_layouts(rows).withColumn("codes", S.transferred(F.col("codes"))))


def build(tasks: DataFrame, modes: tuple[str, ...], n_test: int, seed: str) -> DataFrame:
    """The test formats of each mode for every row (task, template): (mode, task, template, number, ord, codes).

    Valid draws of the reference task come in order; one is kept if it is valid on
    all tasks and no kept one has its essential key, until there are ``n_test``.
    After ``ATTEMPTS`` times as many draws a mode that is still short raises.
    """
    spark = tasks.sparkSession
    named = spark.createDataFrame([(m, L.REFERENCE, m) for m in modes], "name string, template string, mode string")
    drawn = S.sampled(named, ATTEMPTS * n_test, seed, modes)
    used = F.broadcast(tasks.select("template").distinct())   # at most one row per layout
    here = everywhere(drawn.select(F.col("name").alias("split"), "ord", "codes")).join(used, "template")
    good = here.groupBy("split", "ord").agg(F.bool_and("valid").alias("all")).where("all")
    keyed = drawn.withColumn("number", F.lit(S.NAMES.index(L.REFERENCE))).select(F.col("name").alias("split"), F.col("ord").alias("place"), "codes", S.essential_key(F.col("codes")).alias("key"))
    first = keyed.join(good.withColumnRenamed("ord", "place"), ["split", "place"]).groupBy("split", "key").agg(F.min(F.struct("place", "codes")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("split").orderBy("b.place"))
    chosen = first.withColumn("ord", rank).where(F.col("ord") <= n_test).select("split", "ord", "b.codes")
    counts = {r["split"]: r["count"] for r in chosen.groupBy("split").count().collect()}   # one row per mode
    if short := [m for m in modes if counts.get(m, 0) < n_test]:
        raise RuntimeError(f"fewer than {n_test} test formats after {ATTEMPTS * n_test} attempts: {short}")
    carried = S.with_layouts(chosen).drop("mode").withColumn("codes", S.transferred(F.col("codes")))
    return carried.join(tasks, "template").select(F.col("split").alias("mode"), "task", "template", "number", "ord", "codes")


def transfer_sql(rows: str, key: str) -> str:
    """CTEs tm (which slot takes which) and tr (the formats of ``rows`` on every layout)."""
    moves = [(n, i, j) for n, r in L.RELATIONS.items() for i, j in enumerate(L.transfer(L.RELATIONS[L.REFERENCE], r))]
    keys = ", ".join(f"x.{k.strip()}" for k in key.split(","))
    return f"""{S._values('tm', 'template, slot, source', moves)},
tr AS (SELECT t.template, {keys}, t.slot, t.kind, t.cell, t.rule, t.space, x.code FROM {rows} x JOIN tm ON tm.source = x.slot
  JOIN slots t ON t.template = tm.template AND t.slot = tm.slot AND t.mode = 'random')"""


def build_sql(modes: tuple[str, ...], n_test: int, seed: str, before: str) -> str:
    """CTEs up to ``split`` (mode, task, template, ord, vals, kinds); ``before`` holds the relations and tl (task, template)."""
    tries = ATTEMPTS * n_test
    listed = ", ".join(f"'{m}'" for m in modes)
    return f"""WITH {before},
{S.draws_sql(f"SELECT template, mode, range AS format_id FROM lay, range({10 * tries}) WHERE template = '{L.REFERENCE}' AND mode IN ({listed})", seed, "f.mode")},
{S.cells_sql('fs', 'template, mode, format_id', 'r')},
att AS (SELECT mode, format_id FROM (SELECT mode, format_id, row_number() OVER (PARTITION BY mode ORDER BY format_id) AS n FROM rfv WHERE valid) WHERE n <= {tries}),
fa2 AS (SELECT fs.* FROM fs JOIN att USING (mode, format_id)),
{transfer_sql('fa2', 'mode, format_id')},
{S.cells_sql('tr', 'template, mode, format_id', 't')},
good AS (SELECT mode, format_id FROM tfv WHERE template IN (SELECT template FROM tl) GROUP BY mode, format_id HAVING bool_and(valid)),
ek AS (SELECT mode, format_id, concat(coalesce(arg_min(v.value, slot) FILTER (fs.kind = 'chosen_space' AND v.value <> ''), ''),
  coalesce(arg_min(v.value, slot) FILTER (fs.kind = 'chosen_separator' AND v.value <> ''), ''), coalesce(arg_min(v.value, slot) FILTER (fs.kind = 'text_descriptor_fn'), '')) AS key
  FROM fs JOIN good USING (mode, format_id) JOIN vals v USING (code) GROUP BY mode, format_id),
pick AS (SELECT mode, format_id, row_number() OVER (PARTITION BY mode ORDER BY format_id) AS ord FROM (SELECT mode, min(format_id) AS format_id FROM ek GROUP BY mode, key)),
split AS (SELECT p.mode, tl.task, tl.template, p.ord, string_agg(v.value, chr(31) ORDER BY tr.slot) AS vals, string_agg(tr.kind, ',' ORDER BY tr.slot) AS kinds
  FROM pick p JOIN tr ON tr.mode = p.mode AND tr.format_id = p.format_id JOIN tl ON tl.template = tr.template JOIN vals v ON v.code = tr.code
  WHERE p.ord <= {n_test} GROUP BY p.mode, tl.task, tl.template, p.ord)"""
