"""Per-format classification metrics and the per-task record.

Everything is derived from one confusion aggregate per format: each confusion
cell is exploded into a truth-side and a prediction-side contribution, summed
per class, and the per-format metrics follow from integer class totals in a
single grouped aggregate.  No joins, one shuffle per grouping level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptspread.functions.stats import exclusive_quartile, ratio, with_position

METRICS = ("accuracy", "balanced_accuracy", "macro_f1_score", "weighted_f1_score", "matthews_corrcoef")


def confusion(preds: DataFrame, keys: list[str], truth: str = "answer", pred: str = "generation") -> DataFrame:
    """Counts per (keys, truth class, predicted class); partial aggregation map-side."""
    return (preds.groupBy(*keys, F.col(truth).alias("y_true"), F.col(pred).alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_totals(conf: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, class k): t = truth count, p = predicted count, tp = both."""
    sides = F.array(
        F.struct(F.col("y_true").alias("k"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("y_pred").alias("k"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("bigint").alias("tp")))
    x = conf.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    return x.groupBy(*keys, "k").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))


def format_metrics(preds: DataFrame, keys: list[str], truth: str = "answer", pred: str = "generation") -> DataFrame:
    """F1-F5 per format: n, n_right, accuracy, balanced accuracy, macro/weighted F1, Matthews.

    * balanced accuracy: mean recall over classes present in the truth;
    * macro F1: mean of 2tp/(t+p) over truth-or-predicted classes;
    * weighted F1: the same weighted by truth counts;
    * Matthews: (c*s - sum t*p) / sqrt((s^2 - sum p^2)(s^2 - sum t^2)), 0 if the root is 0.
    """
    ct = class_totals(confusion(preds, keys, truth, pred), keys)
    f1 = 2 * F.col("tp").cast("double") / (F.col("t") + F.col("p"))
    s = F.sum("t").cast("double")
    c = F.sum("tp").cast("double")
    cov_tp = c * s - F.sum(F.col("t") * F.col("p")).cast("double")
    cov_pp = s * s - F.sum(F.col("p") * F.col("p")).cast("double")
    cov_tt = s * s - F.sum(F.col("t") * F.col("t")).cast("double")
    return ct.groupBy(*keys).agg(
        F.sum("t").alias("n"),
        F.sum("tp").alias("n_right"),
        ratio(F.sum("tp"), F.sum("t")).alias("accuracy"),
        F.avg(F.when(F.col("t") > 0, F.col("tp").cast("double") / F.col("t"))).alias("balanced_accuracy"),
        F.avg(f1).alias("macro_f1_score"),
        (F.sum(f1 * F.col("t")) / s).alias("weighted_f1_score"),
        F.when(cov_pp * cov_tt == 0, F.lit(0.0))
         .otherwise(cov_tp / F.sqrt(cov_tt * cov_pp)).alias("matthews_corrcoef"))


def accuracy_triple(flags: DataFrame, keys: list[str], right: str = "right", wrong: str = "wrong") -> DataFrame:
    """(right_ratio, wrong_ratio, total) with denominator max(total, 1)."""
    return flags.groupBy(*keys).agg(
        ratio(F.count_if(F.col(right)), F.count(F.lit(1))).alias("right_ratio"),
        ratio(F.count_if(F.col(wrong)), F.count(F.lit(1))).alias("wrong_ratio"),
        F.count(F.lit(1)).alias("total"))


def best_worst(fm: DataFrame, group: list[str], order_col: str = "format_id", value: str = "accuracy") -> DataFrame:
    """best and worst format per group; the first format in order wins ties.

    ``min(struct(...))`` is a plain hash aggregate (partial per task) - no window.
    """
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(order_col).alias("o"), F.col("n").alias("n")))
    worst = F.min(F.struct(F.col(value).alias("v"), F.col(order_col).alias("o"), F.col("n").alias("n")))
    return fm.groupBy(*group).agg(best.alias("__b"), worst.alias("__w")).select(
        *group,
        F.col("__b.o").alias("best_format"), (-F.col("__b.v")).alias("best_accuracy"), F.col("__b.n").alias("best_n"),
        F.col("__w.o").alias("worst_format"), F.col("__w.v").alias("worst_accuracy"), F.col("__w.n").alias("worst_n"))


def task_record(fm: DataFrame, group: list[str], order_col: str = "format_id") -> DataFrame:
    """one wide record per group (task) from per-format metrics.

    Window functions run on per-format rows only (already aggregated).
    """
    x = with_position(fm, group, "matthews_corrcoef")
    others = F.col(order_col) != F.col("__first")
    x = x.withColumn("__first", F.min(order_col).over(Window.partitionBy(*group)))
    x = x.withColumn("__default", F.max(F.when(~others, F.col("accuracy"))).over(Window.partitionBy(*group)))
    best = F.min(F.struct((-F.col("accuracy")).alias("v"), F.col(order_col).alias("o"), F.col("n").alias("n")))
    worst = F.min(F.struct(F.col("accuracy").alias("v"), F.col(order_col).alias("o"), F.col("n").alias("n")))
    aggs = [
        F.max("__default").alias("default_accuracy"),
        best.alias("__b"), worst.alias("__w"),
        F.coalesce(F.avg(F.when(others, F.col("__default") - F.col("accuracy"))), F.lit(0.0)).alias("mean_drop"),
    ]
    for m in METRICS:
        aggs.append(F.median(m).alias(f"median_{m}"))
    for m in METRICS:
        aggs.append(F.stddev_samp(m).alias(f"std_{m}"))
    for m in METRICS:
        aggs.append((F.max(m) - F.min(m)).alias(f"spread_{m}"))
    aggs += [exclusive_quartile(i, "matthews_corrcoef").alias(f"__q{i}") for i in (1, 2, 3)]
    r = x.groupBy(*group).agg(*aggs)
    return r.select(
        *group, "default_accuracy",
        (-F.col("__b.v")).alias("best_accuracy"), F.col("__w.v").alias("worst_accuracy"), "mean_drop",
        F.col("__b.o").alias("best_format"), F.col("__w.o").alias("worst_format"),
        F.col("__b.n").alias("best_n"), F.col("__w.n").alias("worst_n"),
        *[f"median_{m}" for m in METRICS if m != "matthews_corrcoef"],
        F.col("__q2").alias("median_matthews_corrcoef"),
        *[f"std_{m}" for m in METRICS], *[f"spread_{m}" for m in METRICS],
        (F.col("__q3") - F.col("__q2")).alias("upper_error_matthews_corrcoef"),
        (F.col("__q2") - F.col("__q1")).alias("lower_error_matthews_corrcoef"),
        (F.col("__q3") - F.col("__q1")).alias("iqr_matthews_corrcoef"))


def plain_accuracy(preds: DataFrame, keys: list[str], truth: str = "answer", pred: str = "generation") -> DataFrame:
    """n, n_right and accuracy per key - one partial hash aggregate."""
    hit = F.col(truth) == F.col(pred)
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_right"),
        ratio(F.count_if(hit), F.count(F.lit(1))).alias("accuracy"))


def default_drop(fm: DataFrame, group: list[str], order_col: str = "format_id", value: str = "accuracy") -> DataFrame:
    """F8: value of the first format (the default) and mean drop of every other format, 0 if none."""
    w = Window.partitionBy(*group)
    x = fm.withColumn("__first", F.min(order_col).over(w))
    x = x.withColumn("__default", F.max(F.when(F.col(order_col) == F.col("__first"), F.col(value))).over(w))
    others = F.col(order_col) != F.col("__first")
    return x.groupBy(*group).agg(
        F.max("__default").alias("default_accuracy"),
        F.coalesce(F.avg(F.when(others, F.col("__default") - F.col(value))), F.lit(0.0)).alias("mean_drop"))
