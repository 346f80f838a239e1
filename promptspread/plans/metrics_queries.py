"""Queries F1-F11 and E24 over the predictions view (V1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptspread.functions.stats import exclusive_quartile, with_position
from promptspread.operators import metrics as M
from promptspread.plans.registry import register
from promptspread.sources import views as V

KEYS = ["task", "format_id"]

# DuckDB: per-format class totals and metrics (mirrors operators.metrics.format_metrics).
FM_CTE = """
conf AS (SELECT task, format_id, answer AS y_true, generation AS y_pred, count(*) AS n
         FROM predictions GROUP BY task, format_id, answer, generation),
ct AS (SELECT task, format_id, k, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM (
         SELECT task, format_id, y_true AS k, n AS t, 0 AS p, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM conf
         UNION ALL SELECT task, format_id, y_pred AS k, 0 AS t, n AS p, 0 AS tp FROM conf) u
       GROUP BY task, format_id, k),
fm0 AS (SELECT task, format_id, CAST(sum(t) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS n_right,
               CAST(sum(tp) AS DOUBLE) / greatest(sum(t), 1) AS accuracy,
               avg(CASE WHEN t > 0 THEN CAST(tp AS DOUBLE) / t END) AS balanced_accuracy,
               avg(2 * CAST(tp AS DOUBLE) / (t + p)) AS macro_f1_score,
               sum(2 * CAST(tp AS DOUBLE) / (t + p) * t) / CAST(sum(t) AS DOUBLE) AS weighted_f1_score,
               CAST(sum(t) AS DOUBLE) AS s, CAST(sum(tp) AS DOUBLE) AS c,
               CAST(sum(t * p) AS DOUBLE) AS stp, CAST(sum(p * p) AS DOUBLE) AS spp, CAST(sum(t * t) AS DOUBLE) AS stt
        FROM ct GROUP BY task, format_id),
fm AS (SELECT task, format_id, n, n_right, accuracy, balanced_accuracy, macro_f1_score, weighted_f1_score,
              CASE WHEN (s * s - spp) * (s * s - stt) = 0 THEN 0.0
                   ELSE (c * s - stp) / sqrt((s * s - stt) * (s * s - spp)) END AS matthews_corrcoef
       FROM fm0)"""


def _fm(spark, d):
    return M.format_metrics(V.predictions(spark, d), KEYS)


@register("f1_balanced_accuracy", views=("predictions",), sql=f"""
WITH {FM_CTE}
SELECT task, format_id, round(balanced_accuracy, 6) AS balanced_accuracy FROM fm""")
def f1_balanced_accuracy(spark, d):
    """F1: balanced accuracy (mean recall over truth classes) per format."""
    return _fm(spark, d).select(*KEYS, "balanced_accuracy")


@register("f2_macro_f1", views=("predictions",), sql=f"""
WITH {FM_CTE}
SELECT task, format_id, round(macro_f1_score, 6) AS macro_f1_score FROM fm""")
def f2_macro_f1(spark, d):
    """F2: macro F1 over truth-or-predicted classes per format."""
    return _fm(spark, d).select(*KEYS, "macro_f1_score")


@register("f3_weighted_f1", views=("predictions",), sql=f"""
WITH {FM_CTE}
SELECT task, format_id, round(weighted_f1_score, 6) AS weighted_f1_score FROM fm""")
def f3_weighted_f1(spark, d):
    """support-weighted F1 per format."""
    return _fm(spark, d).select(*KEYS, "weighted_f1_score")


@register("f4_matthews", views=("predictions",), sql=f"""
WITH {FM_CTE}
SELECT task, format_id, round(matthews_corrcoef, 6) AS matthews_corrcoef FROM fm""")
def f4_matthews(spark, d):
    """multiclass Matthews correlation per format."""
    return _fm(spark, d).select(*KEYS, "matthews_corrcoef")


@register("f5_format_accuracy", views=("predictions",), sql="""
SELECT task, format_id, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN generation = answer THEN 1 ELSE 0 END) AS BIGINT) AS n_right,
       round(CAST(sum(CASE WHEN generation = answer THEN 1 ELSE 0 END) AS DOUBLE) / greatest(count(*), 1), 6) AS accuracy
FROM predictions GROUP BY task, format_id""")
def f5_format_accuracy(spark, d):
    """plain accuracy per (task, format)."""
    return M.plain_accuracy(V.predictions(spark, d), KEYS)


@register("f6_best_worst_format", views=("predictions",), sql="""
WITH acc AS (SELECT task, format_id, count(*) AS n,
                    CAST(sum(CASE WHEN generation = answer THEN 1 ELSE 0 END) AS DOUBLE) / greatest(count(*), 1) AS accuracy
             FROM predictions GROUP BY task, format_id),
b AS (SELECT task, format_id, n, accuracy,
             row_number() OVER (PARTITION BY task ORDER BY accuracy DESC, format_id) AS rb,
             row_number() OVER (PARTITION BY task ORDER BY accuracy ASC, format_id) AS rw FROM acc)
SELECT task,
       max(CASE WHEN rb = 1 THEN format_id END) AS best_format, round(max(CASE WHEN rb = 1 THEN accuracy END), 6) AS best_accuracy,
       CAST(max(CASE WHEN rb = 1 THEN n END) AS BIGINT) AS best_n,
       max(CASE WHEN rw = 1 THEN format_id END) AS worst_format, round(max(CASE WHEN rw = 1 THEN accuracy END), 6) AS worst_accuracy,
       CAST(max(CASE WHEN rw = 1 THEN n END) AS BIGINT) AS worst_n
FROM b GROUP BY task""")
def f6_best_worst_format(spark, d):
    """best and worst format per task, first format wins ties."""
    return M.best_worst(M.plain_accuracy(V.predictions(spark, d), KEYS), ["task"])


@register("f7_median_std", views=("predictions",), sql=f"""
WITH {FM_CTE}
SELECT task,
  round(median(accuracy), 6) AS median_accuracy, round(median(balanced_accuracy), 6) AS median_balanced_accuracy,
  round(median(macro_f1_score), 6) AS median_macro_f1_score, round(median(weighted_f1_score), 6) AS median_weighted_f1_score,
  round(median(matthews_corrcoef), 6) AS median_matthews_corrcoef,
  round(stddev_samp(accuracy), 6) AS std_accuracy, round(stddev_samp(balanced_accuracy), 6) AS std_balanced_accuracy,
  round(stddev_samp(macro_f1_score), 6) AS std_macro_f1_score, round(stddev_samp(weighted_f1_score), 6) AS std_weighted_f1_score,
  round(stddev_samp(matthews_corrcoef), 6) AS std_matthews_corrcoef
FROM fm GROUP BY task""")
def f7_median_std(spark, d):
    """median and sample standard deviation over formats for the five metrics."""
    fm = _fm(spark, d)
    return fm.groupBy("task").agg(
        *[F.median(m).alias(f"median_{m}") for m in M.METRICS],
        *[F.stddev_samp(m).alias(f"std_{m}") for m in M.METRICS])


@register("f8_default_drop", views=("predictions",), sql="""
WITH acc AS (SELECT task, format_id,
                    CAST(sum(CASE WHEN generation = answer THEN 1 ELSE 0 END) AS DOUBLE) / greatest(count(*), 1) AS accuracy
             FROM predictions GROUP BY task, format_id),
x AS (SELECT *, min(format_id) OVER (PARTITION BY task) AS f0 FROM acc),
y AS (SELECT *, max(CASE WHEN format_id = f0 THEN accuracy END) OVER (PARTITION BY task) AS dflt FROM x)
SELECT task, round(max(dflt), 6) AS default_accuracy,
       round(coalesce(avg(CASE WHEN format_id <> f0 THEN dflt - accuracy END), 0.0), 6) AS mean_drop
FROM y GROUP BY task""")
def f8_default_drop(spark, d):
    """F8: default-format (first) accuracy and mean drop of the other formats."""
    fm = M.plain_accuracy(V.predictions(spark, d), KEYS)
    return M.default_drop(fm, ["task"])


@register("f9_spread", views=("predictions",), sql=f"""
WITH {FM_CTE}
SELECT task,
  round(max(accuracy) - min(accuracy), 6) AS spread_accuracy,
  round(max(balanced_accuracy) - min(balanced_accuracy), 6) AS spread_balanced_accuracy,
  round(max(macro_f1_score) - min(macro_f1_score), 6) AS spread_macro_f1_score,
  round(max(weighted_f1_score) - min(weighted_f1_score), 6) AS spread_weighted_f1_score,
  round(max(matthews_corrcoef) - min(matthews_corrcoef), 6) AS spread_matthews_corrcoef
FROM fm GROUP BY task""")
def f9_spread(spark, d):
    """spread = max - min over formats for the five metrics."""
    fm = _fm(spark, d)
    return fm.groupBy("task").agg(*[(F.max(m) - F.min(m)).alias(f"spread_{m}") for m in M.METRICS])


QUART_SQL = """
pos AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY matthews_corrcoef) AS rn,
               count(*) OVER (PARTITION BY task) AS cnt FROM fm),
jj AS (SELECT *, least(greatest(CAST(floor(1 * (cnt + 1) / 4) AS BIGINT), 1), cnt - 1) AS j1,
              least(greatest(CAST(floor(2 * (cnt + 1) / 4) AS BIGINT), 1), cnt - 1) AS j2,
              least(greatest(CAST(floor(3 * (cnt + 1) / 4) AS BIGINT), 1), cnt - 1) AS j3 FROM pos),
dd AS (SELECT *, 1 * (cnt + 1) - j1 * 4 AS d1, 2 * (cnt + 1) - j2 * 4 AS d2, 3 * (cnt + 1) - j3 * 4 AS d3 FROM jj),
qq AS (SELECT task,
         (max(CASE WHEN rn = j1 THEN matthews_corrcoef * (4 - d1) END) + max(CASE WHEN rn = j1 + 1 THEN matthews_corrcoef * d1 END)) / 4 AS q1,
         (max(CASE WHEN rn = j2 THEN matthews_corrcoef * (4 - d2) END) + max(CASE WHEN rn = j2 + 1 THEN matthews_corrcoef * d2 END)) / 4 AS q2,
         (max(CASE WHEN rn = j3 THEN matthews_corrcoef * (4 - d3) END) + max(CASE WHEN rn = j3 + 1 THEN matthews_corrcoef * d3 END)) / 4 AS q3
       FROM dd GROUP BY task)"""


@register("f10_quartiles", views=("predictions",), sql=f"""
WITH {FM_CTE}, {QUART_SQL}
SELECT task, round(q1, 6) AS q1_matthews_corrcoef, round(q2, 6) AS median_matthews_corrcoef,
       round(q3, 6) AS q3_matthews_corrcoef, round(q3 - q1, 6) AS iqr_matthews_corrcoef,
       round(q3 - q2, 6) AS upper_error_matthews_corrcoef, round(q2 - q1, 6) AS lower_error_matthews_corrcoef
FROM qq""")
def f10_quartiles(spark, d):
    """exclusive quartiles of Matthews over formats, IQR and error bars."""
    x = with_position(_fm(spark, d), ["task"], "matthews_corrcoef")
    q = x.groupBy("task").agg(*[exclusive_quartile(i, "matthews_corrcoef").alias(f"q{i}") for i in (1, 2, 3)])
    return q.select("task", F.col("q1").alias("q1_matthews_corrcoef"), F.col("q2").alias("median_matthews_corrcoef"),
                    F.col("q3").alias("q3_matthews_corrcoef"), (F.col("q3") - F.col("q1")).alias("iqr_matthews_corrcoef"),
                    (F.col("q3") - F.col("q2")).alias("upper_error_matthews_corrcoef"),
                    (F.col("q2") - F.col("q1")).alias("lower_error_matthews_corrcoef"))


TASK_RECORD_SQL = f"""
WITH {FM_CTE}, {QUART_SQL},
w AS (SELECT *, min(format_id) OVER (PARTITION BY task) AS f0, max(accuracy) OVER (PARTITION BY task) AS mx,
             min(accuracy) OVER (PARTITION BY task) AS mn FROM fm),
w2 AS (SELECT *, max(CASE WHEN format_id = f0 THEN accuracy END) OVER (PARTITION BY task) AS dflt FROM w),
agg AS (SELECT task, max(dflt) AS default_accuracy, max(accuracy) AS best_accuracy, min(accuracy) AS worst_accuracy,
               coalesce(avg(CASE WHEN format_id <> f0 THEN dflt - accuracy END), 0.0) AS mean_drop,
               min(CASE WHEN accuracy = mx THEN format_id END) AS best_format,
               min(CASE WHEN accuracy = mn THEN format_id END) AS worst_format,
               median(accuracy) AS median_accuracy, median(balanced_accuracy) AS median_balanced_accuracy,
               median(macro_f1_score) AS median_macro_f1_score, median(weighted_f1_score) AS median_weighted_f1_score,
               stddev_samp(accuracy) AS std_accuracy, stddev_samp(balanced_accuracy) AS std_balanced_accuracy,
               stddev_samp(macro_f1_score) AS std_macro_f1_score, stddev_samp(weighted_f1_score) AS std_weighted_f1_score,
               stddev_samp(matthews_corrcoef) AS std_matthews_corrcoef,
               max(accuracy) - min(accuracy) AS spread_accuracy,
               max(balanced_accuracy) - min(balanced_accuracy) AS spread_balanced_accuracy,
               max(macro_f1_score) - min(macro_f1_score) AS spread_macro_f1_score,
               max(weighted_f1_score) - min(weighted_f1_score) AS spread_weighted_f1_score,
               max(matthews_corrcoef) - min(matthews_corrcoef) AS spread_matthews_corrcoef
        FROM w2 GROUP BY task)
SELECT a.task, round(default_accuracy, 6) AS default_accuracy, round(best_accuracy, 6) AS best_accuracy,
       round(worst_accuracy, 6) AS worst_accuracy, round(mean_drop, 6) AS mean_drop,
       best_format, worst_format,
       (SELECT n FROM fm WHERE fm.task = a.task AND fm.format_id = a.best_format) AS best_n,
       (SELECT n FROM fm WHERE fm.task = a.task AND fm.format_id = a.worst_format) AS worst_n,
       round(median_accuracy, 6) AS median_accuracy, round(median_balanced_accuracy, 6) AS median_balanced_accuracy,
       round(median_macro_f1_score, 6) AS median_macro_f1_score, round(median_weighted_f1_score, 6) AS median_weighted_f1_score,
       round(q2, 6) AS median_matthews_corrcoef,
       round(std_accuracy, 6) AS std_accuracy, round(std_balanced_accuracy, 6) AS std_balanced_accuracy,
       round(std_macro_f1_score, 6) AS std_macro_f1_score, round(std_weighted_f1_score, 6) AS std_weighted_f1_score,
       round(std_matthews_corrcoef, 6) AS std_matthews_corrcoef,
       round(spread_accuracy, 6) AS spread_accuracy, round(spread_balanced_accuracy, 6) AS spread_balanced_accuracy,
       round(spread_macro_f1_score, 6) AS spread_macro_f1_score, round(spread_weighted_f1_score, 6) AS spread_weighted_f1_score,
       round(spread_matthews_corrcoef, 6) AS spread_matthews_corrcoef,
       round(q3 - q2, 6) AS upper_error_matthews_corrcoef, round(q2 - q1, 6) AS lower_error_matthews_corrcoef,
       round(q3 - q1, 6) AS iqr_matthews_corrcoef
FROM agg a JOIN qq ON a.task = qq.task"""


@register("f11_task_record", views=("predictions",), sql=TASK_RECORD_SQL)
def f11_task_record(spark, d):
    """one wide record per task (27 metric columns) - the flagship query."""
    return M.task_record(_fm(spark, d), ["task"])


@register("e24_generation_histogram", views=("predictions",), sql="""
SELECT task, format_id, generation, CAST(count(*) AS BIGINT) AS n FROM predictions GROUP BY task, format_id, generation""")
def e24_generation_histogram(spark, d):
    """Histogram of generations per format."""
    return V.predictions(spark, d).groupBy("task", "format_id", "generation").agg(F.count(F.lit(1)).alias("n"))
