import math
import random

from pyspark.sql import functions as F

from promptspread.llm import topk
from tests.llm.helpers import against_oracle


def test_oracle(spark):
    against_oracle(spark, "op4_exact_topk")


def test_brute_force_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 0.001, rng.uniform(-1, 1)]) for _ in range(rng.choice([6, 6, 4]))], "x") for i in range(150)]
    rows += [(200, [1.0] * 6, "x"), (300, [1.0] * 6, "x"), (301, [1.0] * 6, "x"), (400, None, "x"), (500, [None] * 6, "x"), (600, [float("nan")] * 6, "x"),
             (700, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x"), (800, [], "x"), (7, rows[7][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = topk.search(df, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), topk.quantised(F.col("embedding")), k=7, block_rows=40, query_rows=2)
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:7]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in got.collect()} == expected
    assert topk.search(df.limit(0), F.lit(True), topk.quantised(F.col("embedding"))).count() == 0
