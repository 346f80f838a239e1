"""Structured Streaming form of E17, file sources (A1, A2, A3, A5) on hand-made files."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from promptspread.operators import instances as I
from promptspread.sources import files as IO
from tests.conftest import SF_SMALL


def test_stream_running_accuracy_matches_batch_and_survives_a_restart(spark, tmp_path):
    from promptspread.sources import views as V
    from promptspread.streaming.cumulative import BLOCKS, start_running_accuracy, totals
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    middle = events.selectExpr("percentile_approx(event_id, 0.4) AS m").first().m
    folder, name = str(tmp_path / "in"), f"acc_{uuid.uuid4().hex[:8]}"

    def run(part):
        events.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/new")
        for f in os.listdir(f"{folder}/new"):   # the stream reads files named like the table
            if f.endswith(".parquet") and not f.startswith("events"):
                os.rename(f"{folder}/new/{f}", f"{folder}/events-{f}")
        start_running_accuracy(spark, folder, name, checkpoint=str(tmp_path / "ckpt")).awaitTermination(120)
        state = spark.sql(f"SELECT * FROM {name}")
        assert state.groupBy("arm").count().agg(F.max("count")).first()[0] <= BLOCKS
        return {r.arm: (r.cum_total, r.cum_successes) for r in totals(state).collect()}

    o = V.arm_outcomes(spark, SF_SMALL)
    want = {r.arm: (r.n, r.s) for r in o.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("s")).collect()}
    first = run(F.col("event_id") <= middle)
    assert sum(n for n, _ in first.values()) == events.where(F.col("event_id") <= middle).count() < events.count()
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    assert run(F.col("event_id") > middle) == want


def _write(path, name, obj):
    with open(os.path.join(path, name), "w") as f:
        json.dump(obj, f)


def test_read_tasks_and_pick(spark, tmp_path):
    d = str(tmp_path / "tasks")
    os.makedirs(d)
    _write(d, "task001_demo.json", {"Definition": ["Say yes."], "Instances": [
        {"id": "a", "input": "x {} y", "output": ["yes"]}, {"id": "b", "input": "z", "output": ["no"]}]})
    _write(d, "task002_other.json", {"Definition": ["Other."], "Instances": [{"id": "c", "input": "q", "output": ["1"]}]})
    inst = IO.read_tasks(spark, d).orderBy("task", "instance_id").collect()
    assert [(r.task, r.instance_id, r.input, r.output) for r in inst] == [
        ("task001_demo", 0, "x {} y", ["yes"]), ("task001_demo", 1, "z", ["no"]), ("task002_other", 0, "q", ["1"])]
    one = IO.pick_task_file(spark, d, "task001_").collect()
    assert len(one) == 1 and one[0].unique
    both = IO.pick_task_file(spark, d, "task00").collect()
    assert all(not r.unique for r in both)


def test_instruction_choice(spark, tmp_path):
    d = str(tmp_path / "ind")
    os.makedirs(d)
    _write(d, "antonyms.json", {"annotations": ["short one", "Longest Upper", "Other upper", "lower but the longest of all"],
                                "examples": {"1": {"input": "hot", "output": "cold"}}})
    ex = IO.read_induction(spark, d).collect()
    assert ex[0].output == ["cold"]
    ann = spark.createDataFrame([("antonyms", i, a) for i, a in enumerate(
        ["short one", "Longest Upper", "Other upper", "lower but the longest of all"])], "task string, i long, text string")
    r = I.choose_instruction(ann, ["task"], "text", "i").collect()[0]
    assert r.instruction_id == 1   # "Longest Upper" and "Other upper" tie on length: first wins


def test_conversation_csv_rejects(spark, tmp_path):
    p = tmp_path / "conv.csv"
    p.write_text('id,conversations\n1,"[{\'from\': \'human\', \'value\': \'hi\'}, {\'from\': \'gpt\', \'value\': \'yo\'}]"\n'
                 '2,"not a list"\n')
    ok, bad = IO.read_conversation_csv(spark, str(p))
    rows = ok.collect()
    assert len(rows) == 1 and rows[0].turns[1]["value"] == "yo"
    assert bad.count() == 1


def test_fill_template_keeps_braces_in_fields(spark):
    from promptspread.operators.prompts import fill_template, hole_mismatch
    df = spark.createDataFrame([("A: {}\nB: {}", ["x {} y", "z"])], "t string, f array<string>")
    r = df.select(fill_template(F.col("t"), F.col("f")).alias("s"), hole_mismatch(F.col("t"), F.col("f")).alias("m")).collect()[0]
    assert r.s == "A: {}\nB: {}".format("x {} y", "z") and not r.m


def test_template_regex_round_trip(spark):
    tmpl = "Q: {}\nA: {}"
    pat = I.regex_literal(tmpl)
    df = spark.createDataFrame([("Q: what (is) it?\nA: 42",)], "s string")
    r = df.select(F.regexp_extract("s", pat, 1).alias("a"), F.regexp_extract("s", pat, 2).alias("b")).collect()[0]
    assert (r.a, r.b) == ("what (is) it?", "42")
