"""F1-F11 against plain-Python references on hand-made rows."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from promptspread.functions.stats import exclusive_quartile, with_position
from promptspread.operators import metrics as M


def py_metrics(y_true, y_pred):
    labels = sorted(set(y_true) | set(y_pred))
    t = {k: sum(1 for y in y_true if y == k) for k in labels}
    p = {k: sum(1 for y in y_pred if y == k) for k in labels}
    tp = {k: sum(1 for a, b in zip(y_true, y_pred) if a == b == k) for k in labels}
    bal = statistics.mean(tp[k] / t[k] for k in labels if t[k] > 0)
    f1 = {k: (2 * tp[k] / (t[k] + p[k]) if t[k] + p[k] else 0.0) for k in labels}
    macro = statistics.mean(f1.values())
    weighted = sum(f1[k] * t[k] for k in labels) / sum(t.values())
    s, c = len(y_true), sum(tp.values())
    num = c * s - sum(t[k] * p[k] for k in labels)
    den = math.sqrt((s * s - sum(v * v for v in p.values())) * (s * s - sum(v * v for v in t.values())))
    mcc = 0.0 if den == 0 else num / den
    return bal, macro, weighted, mcc


CASES = [
    ([0, 0, 1, 1, 1, 0], [0, 1, 1, 1, 0, 0]),
    ([0, 1, 2, 2, 1], [0, 2, 2, 2, 3]),          # predicted class outside truth
    ([1, 1, 1], [1, 1, 1]),                      # single class: Matthews denominator 0
    ([0, 1, 0, 1], [2, 2, 2, 2]),                # nothing right
]


@pytest.mark.parametrize("y_true,y_pred", CASES)
def test_format_metrics_match_python(spark, y_true, y_pred):
    df = spark.createDataFrame([(0, a, b) for a, b in zip(y_true, y_pred)], "f int, answer int, generation int")
    r = M.format_metrics(df, ["f"]).collect()[0]
    bal, macro, weighted, mcc = py_metrics(y_true, y_pred)
    assert r.balanced_accuracy == pytest.approx(bal)
    assert r.macro_f1_score == pytest.approx(macro)
    assert r.weighted_f1_score == pytest.approx(weighted)
    assert r.matthews_corrcoef == pytest.approx(mcc)
    assert r.accuracy == pytest.approx(sum(a == b for a, b in zip(y_true, y_pred)) / len(y_true))


@pytest.mark.parametrize("xs", [[1, 2, 4, 8, 16], [3.0, 1.0], [5, 1, 4, 2, 3, 9, 7], [0.5, 0.25, 0.75, 0.1]])
def test_exclusive_quartiles(spark, xs):
    df = spark.createDataFrame([(0, float(x)) for x in xs], "g int, v double")
    x = with_position(df, ["g"], "v")
    r = x.groupBy("g").agg(*[exclusive_quartile(i, "v").alias(f"q{i}") for i in (1, 2, 3)]).collect()[0]
    want = statistics.quantiles(xs, n=4)
    assert [r.q1, r.q2, r.q3] == pytest.approx(want)


def test_quartile_single_value_is_null(spark):
    df = spark.createDataFrame([(0, 1.0)], "g int, v double")
    x = with_position(df, ["g"], "v")
    assert x.groupBy("g").agg(exclusive_quartile(2, "v").alias("q")).collect()[0].q is None


def test_best_worst_first_wins_ties(spark):
    fm = spark.createDataFrame([("t", 0, 0.5, 10), ("t", 1, 0.9, 10), ("t", 2, 0.9, 11), ("t", 3, 0.5, 12)],
                               "task string, format_id int, accuracy double, n long")
    r = M.best_worst(fm, ["task"]).collect()[0]
    assert (r.best_format, r.best_n, r.worst_format, r.worst_n) == (1, 10, 0, 10)


def test_default_drop(spark):
    fm = spark.createDataFrame([("t", 0, 0.8), ("t", 1, 0.6), ("t", 2, 0.7)], "task string, format_id int, accuracy double")
    r = M.default_drop(fm, ["task"]).collect()[0]
    assert r.default_accuracy == pytest.approx(0.8)
    assert r.mean_drop == pytest.approx(((0.8 - 0.6) + (0.8 - 0.7)) / 2)
    one = spark.createDataFrame([("t", 0, 0.8)], "task string, format_id int, accuracy double")
    assert M.default_drop(one, ["task"]).collect()[0].mean_drop == 0.0


def test_task_record_columns(spark):
    from promptspread.sources import views as V
    from tests.conftest import SF_SMALL
    r = M.task_record(M.format_metrics(V.predictions(spark, SF_SMALL), ["task", "format_id"]), ["task"])
    assert len(r.columns) == 27  # task + 26 metric columns, as the reference record
    rows = r.collect()
    assert {x.task for x in rows} == {"quality", "toxic"}
    for x in rows:
        assert 0 <= x.spread_accuracy <= 1
        assert x.best_accuracy >= x.median_accuracy >= x.worst_accuracy
