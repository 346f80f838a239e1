"""Scoring operators (E1-E16, E25): class scores, ranking, calibration, votes.

Model outputs arrive as long tables.  Per-instance choices use hash
aggregates over structs (``max(struct(score, -class))``) instead of sorted
windows: partial aggregation runs map-side and no partition is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptspread.functions.ranking import hashed_rank, running_sums, seeded_key
from promptspread.functions.text import clean_text, normalize_generation, prefix_match


def class_score(tokens: DataFrame, keys: list[str], pos_col: str = "pos_from_end",
                len_col: str = "answer_length", value: str = "logprob") -> DataFrame:
    """Class score = sum of token log-probs over the class's last ``answer_length`` positions."""
    return (tokens.where(F.col(pos_col) < F.col(len_col))
            .groupBy(*keys).agg(F.sum(value).alias("score")))


def log_softmax(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """``x - ln(sum(exp(x - max)) ) - max`` within ``group`` (a small window, e.g. classes of one instance)."""
    w = Window.partitionBy(*group)
    mx = F.max(value).over(w)
    return df.withColumn(out, F.col(value) - mx - F.log(F.sum(F.exp(F.col(value) - mx)).over(w)))


def argmax_class(scores: DataFrame, keys: list[str], cls: str = "class", score: str = "score",
                 carry: list[str] | None = None) -> DataFrame:
    """The class with the highest score per key; ties go to the smallest class."""
    carry = carry or []
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(cls)).alias("nc")))
    aggs = [best.alias("__best")] + [F.first(c).alias(c) for c in carry]
    return (scores.groupBy(*keys).agg(*aggs)
            .select(*keys, (-F.col("__best.nc")).alias("pred_class"), F.col("__best.s").alias("pred_score"), *carry))


def top_k(scores: DataFrame, keys: list[str], k: int, score: str = "score", cls: str = "class") -> DataFrame:
    """The k best entries per key (``row_number <= k``; Spark adds a partial group limit)."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(cls))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def evaluation_order(rows: DataFrame, seed: int, inst: str = "instance_id") -> DataFrame:
    """(instance, ord): every instance's place in the seeded order of the evaluation, from 0."""
    distinct = rows.select(inst).distinct().withColumn("__k", seeded_key(seed, inst))
    return hashed_rank(distinct, [], "__k", out_col="ord", tiebreak=[inst]).select(inst, (F.col("ord") - 1).alias("ord"))


def batch_calibrated_scores(tokens: DataFrame, order: DataFrame, batch_size: int, fmt: str = "format_id", inst: str = "instance_id") -> DataFrame:
    """Subtract the running mean (over batches, current included) of per-batch mean log-probs.

    Batches follow the evaluation order (instance, ord).  The mean is taken per
    (format, class, position, batch) first; the running mean over the batches goes
    block by block, because there are few such keys and batches without end.
    """
    key = [fmt, "class", "pos_from_end"]
    t = tokens.join(order.select(inst, F.floor(F.col("ord") / batch_size).alias("batch_no")), inst)
    p_hat = t.groupBy(*key, "batch_no").agg(F.avg("logprob").alias("p_hat")).withColumn("one", F.lit(1))
    run = running_sums(p_hat, key, "batch_no", {"total": "p_hat", "batches": "one"})
    cal = t.join(run.select(*key, "batch_no", (F.col("total") / F.col("batches")).alias("pr")), [*key, "batch_no"])
    return class_score(cal.withColumn("logprob", F.col("logprob") - F.col("pr")), [fmt, inst, "class"])


def sensitivity_scores(scores: DataFrame, alpha: float, copy_col: str = "format_id",
                       keys: tuple[str, ...] = ("instance_id", "class")) -> DataFrame:
    """E5: ``alpha*real - (1-alpha)*var_samp(perturbed copies)``; copy 0 is the real prompt."""
    real = F.max(F.when(F.col(copy_col) == 0, F.col("score")))
    var = F.var_samp(F.when(F.col(copy_col) > 0, F.col("score")))
    return scores.groupBy(*keys).agg((F.lit(alpha) * real - F.lit(1 - alpha) * var).alias("score"))


def softmax_ensemble(scores: DataFrame, ensemble_col: str, inst: str = "instance_id") -> DataFrame:
    """Mean softmax over the formats of an ensemble, per (ensemble, instance, class)."""
    w = Window.partitionBy("format_id", inst)
    mx = F.max("score").over(w)
    e = F.exp(F.col("score") - mx)
    p = scores.withColumn("prob", e / F.sum(e).over(w))
    return p.groupBy(ensemble_col, inst, "class").agg(F.avg("prob").alias("prob"))


def output_classes(df: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """Sorted distinct answers per key, with the reference's guards as flags."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(answer)).alias("classes")).withColumn(
        "n_classes", F.size("classes"))


def match_flags(df: DataFrame, classes_col: str = "classes", gen: str = "generation",
                answer: str = "answer") -> DataFrame:
    """Right / wrong / other; wrong = matches any *other* class (right and wrong may both hold)."""
    g = clean_text(F.col(gen))
    right = prefix_match(g, clean_text(F.col(answer)))
    others = F.filter(F.col(classes_col), lambda c: c != F.col(answer))
    wrong = F.exists(others, lambda c: prefix_match(g, clean_text(c)))
    return (df.withColumn("right", F.coalesce(right, F.lit(False)))
              .withColumn("wrong", F.coalesce(wrong, F.lit(False)))
              .withColumn("other", ~F.col("right") & ~F.col("wrong")))


def ranking_flags(pred: Column, answer: Column, classes: Column) -> tuple[Column, Column, Column]:
    """(equal, wrong-but-in-classes, not-in-classes)."""
    inside = F.array_contains(classes, pred)
    return pred == answer, (pred != answer) & inside, ~inside


def majority_vote(df: DataFrame, keys: list[str], value: str, order_col: str) -> DataFrame:
    """Most frequent value per key; ties go to the value first seen in ``order_col`` order."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order_col).alias("__first"))
    best = F.max(F.struct(F.col("votes"), (-F.col("__first")).alias("nf"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, F.col("__b.v").alias("vote"), F.col("__b.votes").alias("votes"))


def seeded_majority_vote(df: DataFrame, keys: list[str], value: str, seed: int) -> DataFrame:
    """Most frequent normalised value; ties broken by md5(seed|keys|candidate) order."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"))
    tie = seeded_key(seed, *keys, value)
    best = F.min(F.struct((-F.col("votes")).alias("nv"), tie.alias("t"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, F.col("__b.v").alias("vote"), (-F.col("__b.nv")).alias("votes"))


def normalized(df: DataFrame, col: str, out: str, multiple_choice: bool = True) -> DataFrame:
    """E13 as a DataFrame step."""
    return df.withColumn(out, normalize_generation(F.col(col), multiple_choice))


def strip_echo(generation: Column, prompt: Column) -> Column:
    """Drop the echoed prompt (its length in characters) from the front of a generation."""
    return generation.substr(F.length(prompt) + 1, F.length(generation) + 1)
