"""Prompts without a shuffle of texts: where tasks are cut, the sink, and the rows that take part."""

import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from promptspread.operators import prompts as P
from promptspread.plans import QUERIES
from promptspread.plans import prompt_queries as PQ
from promptspread.sources import files as IO
from promptspread.sources import views as V


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with repeated and missing ids, a task of few rows and one text of each kind."""
    rows = [(i, f"text {i} " + "word " * (i % 7), "en", "big" if i % 3 else "mid") for i in range(120)]
    rows += [(i, f"few {i}", "de", "few") for i in range(200, 204)]
    rows += [(i, f"twin {i}", "de", "twins") for i in range(300, 312) for _ in range(3)]
    rows += [(None, "no id", "en", "big"), (501, None, "en", "big"), (502, "", None, "mid")]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def test_heads_and_rest_are_the_instances(spark, folder):
    path, rows = folder
    heads, rest = V.instance_heads(spark, path, 10)
    by_task, nulls = defaultdict(list), defaultdict(int)
    for i, text, lang, source in rows:
        if i is None:
            nulls[source] += 1   # the first places
        else:
            by_task[source].append((hashlib.md5(f"23|{i}".encode()).hexdigest(), i, text, lang))
    first, later = {}, []
    for task, xs in by_task.items():
        xs.sort(key=lambda x: x[0])
        last = xs[min(10 - nulls[task], len(xs)) - 1][0]
        first[task] = [x[1] for x in xs if x[0] <= last]
        later += [(task, x[1], x[2], x[3]) for x in xs if x[0] > last]
    got = defaultdict(list)
    for r in sorted(heads.collect(), key=lambda r: r.ord):
        assert r.ord == nulls[r.task] + len(got[r.task])
        got[r.task].append(r.instance_id)
    assert got == first and len(first["twins"]) == 12   # three rows share the tenth place's key
    none = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, rest.collect()), key=none) == sorted(later, key=none)
    assert "Exchange hashpartitioning(instance_id" not in rest._jdf.queryExecution().toString()


def test_prompts_of_all_evaluation_rows(spark, folder):
    path, _ = folder
    p = PQ.prompts(spark, path).collect()
    formats = PQ.task_formats(spark, path).groupBy("task").count().collect()
    want = V.instances(spark, path).where(F.col("ord") >= PQ.N_EVAL_FROM).groupBy("task").count().collect()
    each = defaultdict(set)
    count = defaultdict(int)
    for r in p:
        each[r.task].add(r.format_id)
        count[r.task] += 1
    assert {r.task: r["count"] * len(each[r.task]) for r in want} == dict(count) and all(r["count"] == PQ.N_FMT for r in formats)
    plan = PQ.prompts(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan   # texts meet their task's few rows where they are read


def test_perturbed_copies_return_only_the_columns_asked_for(spark):
    df = spark.createDataFrame([(str(i), i * 3, " ".join(f"t{j}" for j in range(40))) for i in range(5)], "id string, extra int, text string")
    words = [f"w{i}" for i in range(16)]
    whole = P.with_perturbed(df, "text", ["id"], 2, 0.1, words)
    some = P.with_perturbed(df, "text", ["id"], 2, 0.1, words, keep=["extra"])
    assert some.columns == ["extra", "copy_id", "perturbed", "n_tokens", "n_replaced"]
    assert sorted(some.collect()) == sorted(whole.select(*some.columns).collect())


def test_emitted_prompts_are_compressed_and_whole(spark, folder, tmp_path):
    path, _ = folder
    p = PQ.prompts(spark, path).select("task", "format_id", "instance_id", "prompt", "answer")
    IO.write_jsonl(p, str(tmp_path / "p"), ["task", "format_id"], compression="gzip")
    assert all(f.name.endswith(".json.gz") for f in Path(tmp_path / "p").rglob("part-*"))
    got = {(r.task, r.format_id): (r.n_prompts, r.n_chars) for r in QUERIES["a13_emit_prompts"](spark, path).collect()}
    want = {(r.task, r.format_id): (r.n, r.c) for r in p.groupBy("task", "format_id").agg(F.count("*").alias("n"), F.sum(F.length("prompt")).alias("c")).collect()}
    assert got == want and got
