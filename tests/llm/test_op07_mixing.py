from pyspark.sql import functions as F

from promptspread.llm import mixing
from promptspread.llm.queries import QUERIES
from tests.conftest import SF_ORACLE
from tests.llm.helpers import against_oracle, docs, odd_texts


def shared(sizes, weights, percent=150, epochs=2):
    """Targets by resharing the excess round after round."""
    budget, open_ = sum(sizes) * percent / 100, set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        share = budget / sum(weights[i] for i in open_)
        above = {i for i in open_ if share * weights[i] > epochs * sizes[i]}
        for i in above or open_:
            out[i] = epochs * sizes[i] if above else share * weights[i]
            budget -= out[i]
        open_ -= above or open_
    return out


def test_oracle(spark):
    against_oracle(spark, "op7_source_mix")


def test_targets_and_nearness(spark):
    rows = QUERIES["op7_source_mix"](spark, SF_ORACLE).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "source").collect()}
    names = sorted(set(source.values()))
    size, taken, target = ({n: 0 for n in names} for _ in range(3))
    for r in rows:
        n = source[r.doc_id]
        size[n] += r.size
        taken[n] += r.taken
        target[n] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    want = shared([size[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    assert all(abs(target[n] - w) < 1e-6 * max(1, w) for n, w in zip(names, want))
    assert all(abs(taken[n] - target[n]) <= 0.02 * target[n] for n in names)
    for n in names:   # no document left would still fit
        partial = target[n] % size[n]
        left = [r.size for r in rows if source[r.doc_id] == n and r.size and r.taken == (target[n] // size[n]) * r.size]
        assert partial == 0 or not left or min(left) > target[n] - taken[n] - 1e-6
    again = QUERIES["op7_source_mix"](spark, SF_ORACLE).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_quality_comes_first(spark):
    df = docs(spark, [(i, "five words in this text") for i in range(400)], source="a").unionByName(docs(spark, [(1000 + i, "w " * 3000) for i in range(2)], source="b"))
    quality = df.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, 8.0).alias("weight"))
    plan = mixing.mix(df, quality=quality, weights=(1, 5), percent=60).where("source = 'a'").collect()
    good, rest = (sum(r.times for r in plan if r.id % 2 == k) for k in (0, 1))
    assert good > 2 * rest > 0


def test_odd_rows(spark):
    df = docs(spark, odd_texts(), source=None).unionByName(docs(spark, [(20, "a b"), (21, "")], source="z"))
    plan = mixing.mix(df, quality=df.select(F.col("doc_id").alias("id"), F.lit(None).cast("double").alias("weight")))
    rows = plan.collect()
    assert sum(r.copies for r in rows) == df.count() and {r.source for r in rows} == {None, "z"}
    assert all(r.times <= 2 for r in rows)
    out = mixing.repeated(df, plan)
    assert out.columns == df.columns and out.count() == sum(r.copies * r.times for r in rows)
    assert mixing.mix(df.limit(0)).count() == 0


def test_fills_until_nothing_fits_with_few_long_documents(spark):
    # sizes that halve: every round ends at a document that is too large for what is left
    sizes = [2 ** k for k in range(14, 0, -1)] * 3 + [1, 1, 0]
    df = docs(spark, [(i, "w " * n) for i, n in enumerate(sizes)], source="a").unionByName(docs(spark, [(100, "v " * 7)], source=None))
    for seed in range(3):
        plan = mixing.mix(df, weights=(1,), percent=70, seed=seed).where("source = 'a'").collect()
        target = {r.target for r in plan}.pop()
        missing = target - sum(r.size * r.times for r in plan)
        assert missing >= 0 and all(r.size > missing for r in plan if not r.times and r.size) and {r.times for r in plan} <= {0, 1}
    assert mixing.repeated(df.withColumnRenamed("score", "p_times"), mixing.mix(df, percent=70)).columns == df.withColumnRenamed("score", "p_times").columns


def test_many_sources_are_joined_instead_of_broadcast(spark, monkeypatch):
    df = docs(spark, [(i, "w " * (i % 9)) for i in range(60)], source="a").unionByName(docs(spark, [(100 + i, "v " * i) for i in range(30)], source=None))
    want = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 1)
    assert sorted(map(str, mixing.mix(df).collect())) == want
