"""Result documents, split documents, manifest and folder fingerprint on hand-made rows and files."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from promptspread.sources import files as IO
from promptspread.sources import results as R

LOGS = "experiment string, task string, format_id long, format_text string, instance_id long, answer string, generation string"


def logs(spark, rows):
    return spark.createDataFrame(rows, LOGS)


ROWS = [("m---0-shot", "task1", 0, 'Q: {}\nA: "x"', 5, "yes", "yes"), ("m---0-shot", "task1", 0, 'Q: {}\nA: "x"', 1700, "no", "yes"), ("m---0-shot", "task1", 0, 'Q: {}\nA: "x"', 1701, "no", "maybe"),
        ("m---0-shot", "task1", 1, "Q\t{}", 5, "yes", "no"), ("m---0-shot", "task1", 1, "Q\t{}", 1700, "no", "no"), ("m---0-shot", "task1", 1, "Q\t{}", 1701, "no", None),
        ("m---2-shot", "task2", 7, "Q {}", 5, "a", "a")]


def test_documents_have_the_shape_and_come_back(spark, tmp_path):
    path = str(tmp_path / "r")
    R.write_results(logs(spark, ROWS), path)
    found = sorted((root.split("experiment=")[1], f) for root, _, files in os.walk(path) for f in files if f.endswith(".txt"))
    docs = []
    for name, f in found:
        with open(os.path.join(path, f"experiment={name}", f)) as h:
            docs += [json.loads(line) for line in h]
    assert len(docs) == 3   # instances from 1000 on are a part of their own
    for d in docs:
        assert set(d) == {"generation_order", "edges", "all_structured_prompt_formats_accuracies", "metadata"}
    first = next(d for d in docs if d["metadata"]["nodes"].get("Q\t{}", [0, []])[1][:1] == [{"dataset_idx": 5, "answer": "yes", "generation": "no"}])
    assert first["generation_order"] == {'Q: {}\nA: "x"': 0, "Q\t{}": 1}
    right, wrong, n = first["all_structured_prompt_formats_accuracies"]['Q: {}\nA: "x"']
    assert (round(right, 6), round(wrong, 6), n) == (0.333333, 0.333333, 3)
    scanned = R.scan(spark, path, r"^metadataholistic_")
    got = sorted((r.experiment, r.task, r.format_id, r.instance_id, r.answer, str(r.generation)) for r in R.predictions(scanned).collect())
    assert got == sorted((e, t, f, i, a, str(g)) for e, t, f, _, i, a, g in ROWS)
    acc = {(r.task, r.format_id): (r.format_text, round(r.right, 6), r.n) for r in R.accuracies(scanned).collect()}
    assert acc == {("task1", 0): ('Q: {}\nA: "x"', 0.333333, 3), ("task1", 1): ("Q\t{}", 0.333333, 3), ("task2", 7): ("Q {}", 1.0, 1)}
    assert {r.task for r in R.scan(spark, path, "task2_").collect()} == {"task2"}


def test_rewriting_one_experiment_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "r")
    R.write_results(logs(spark, ROWS), path)
    R.write_results(logs(spark, [(*ROWS[-1][:-1], "b")]), path)
    got = {(r.task, r.format_id, r.instance_id): r.generation for r in R.predictions(R.scan(spark, path, ".")).collect()}
    assert len(got) == 7 and got["task2", 7, 5] == "b"


def test_split_documents(spark, tmp_path):
    path = str(tmp_path / "s")
    formats = spark.createDataFrame([("random", "t", 1, ["\n", "x"], ["chosen_space", "chosen_separator"]), ("random", "t", 2, [" ", ": "], ["chosen_space", "chosen_separator"])],
                                    "mode string, task string, ord int, names array<string>, kinds array<string>")
    order = spark.range(2500).select(F.lit("t").alias("task"), F.col("id").alias("ord"), (2499 - F.col("id")).alias("instance_id"))
    R.write_splits(formats, order, path)
    back = R.read_splits(spark, path).collect()
    assert sorted((r.ord, list(r.names), list(r.action_types)) for r in back if r.kind == "test") == [(0, ["\n", "x"], ["chosen_space", "chosen_separator"]), (1, [" ", ": "], ["chosen_space", "chosen_separator"])]
    assert sorted((r.ord, r.instance_id) for r in back if r.kind == "id") == [(i, 2499 - i) for i in range(2500)]


def test_resume_after_lost_doubled_changed_and_uncommitted_units(spark, tmp_path):
    path, keys = str(tmp_path / "m"), ["unit"]
    rows = spark.createDataFrame([(u, i, f"v{i}") for u in "abcdef" for i in range(4)], "unit string, i int, v string")
    R.commit(spark, rows.where("unit <> 'f'"), keys, path)
    changed = [("a", 0, "v0"), ("a", 1, "v1"), ("a", 2, "v2"), ("a", 3, "v3")][::-1] + [("b", i, f"v{i}") for i in range(3)] + [("c", i, f"v{i}") for i in (0, 1, 2, 3, 3)]
    changed += [("d", i, "other" if i == 2 else f"v{i}") for i in range(4)] + [("f", i, f"v{i}") for i in range(4)]
    planned = spark.createDataFrame([(u, 4) for u in "abcdefg"], "unit string, expected long")
    now = spark.createDataFrame(changed, rows.schema)
    status = lambda units: {r.unit: r.status for r in R.status(planned, units, spark.read.parquet(f"{path}/manifest"), keys).collect()}
    assert status(now) == {"a": "done", "b": "resume", "c": "error", "d": "redo", "e": "todo", "f": "resume", "g": "todo"}
    R.commit(spark, now.where("unit = 'd'"), keys, path)   # the changed unit is committed again
    assert status(now)["d"] == "done" and spark.read.parquet(f"{path}/units").where("unit = 'b'").count() == 4


def test_fingerprint_is_the_digest_of_digests_in_path_order(spark, tmp_path):
    (tmp_path / "e" / "sub").mkdir(parents=True)
    texts = {"b.json": b'{"x": 1}', "a.json": b"{}", "sub/c.json": b"long " * 9000, "note.txt": b"no"}
    for name, data in texts.items():
        (tmp_path / "e" / name).write_bytes(data)
    want = hashlib.md5(b"".join(hashlib.md5(texts[n]).digest() for n in sorted(texts) if n.endswith(".json"))).hexdigest()
    got = IO.fingerprint(spark, str(tmp_path / "e"), "*.json").first()
    assert (got.n_files, got.fingerprint) == (3, want)
    (tmp_path / "e" / "a.json").write_bytes(b" ")
    assert IO.fingerprint(spark, str(tmp_path / "e"), "*.json").first().fingerprint != want


def test_digest_of_a_unit_whose_sum_leaves_a_bigint(spark):
    n = 70_000   # sums of so many numbers of 48 bits are above 2^63
    rows = spark.range(n).select(F.lit("u").alias("unit"), F.col("id").cast("string").alias("v"))
    own = [hashlib.md5(str(i).encode()).hexdigest() for i in range(n)]
    sums = [sum(int(h[at:at + 12], 16) for h in own) for at in (0, 12)]
    assert max(sums) > 2 ** 63
    before = spark.conf.get("spark.sql.ansi.enabled")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            (r,) = R.digests(rows, ["unit"]).collect()
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)
        assert (r.n, r.digest) == (n, f"{sums[0]}-{sums[1]}")
