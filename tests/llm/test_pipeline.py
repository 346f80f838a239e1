import corpus_pipeline
import __spark_entry__
from promptspread.llm import mixing
from promptspread.llm.common import stored
from tests.conftest import SF_SMALL
from tests.llm.helpers import odd_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}


def test_stages_on_documents_and_odd_rows(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*COLUMNS)
    odd = [(None if i is None else 10_000 + i, t, None, None, len(t or "")) for i, t in odd_texts()] + [(20_000, "12 34 !!", "en", "src0", 8)]
    docs = table.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, SF_SMALL), name)
        assert after.columns == COLUMNS
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        assert ids(after) <= ids(before)
        if name == "language_id":
            gone = before.exceptAll(after).collect()
            assert all(r.text is None or not any(c.isalpha() for c in r.text) for r in gone) and 20_000 in {r.doc_id for r in gone}
        if name == "ngram_jaccard_join":
            assert after.count() == after.select("doc_id", "text").distinct().count()
        if name == "source_mixing":
            plan = mixing.mix(before, quality=corpus_pipeline.quality(spark, SF_SMALL))
            want = {(r.id, r.h): r.times * r.copies for r in plan.collect()}
            assert after.count() == sum(want.values())
        before = after
    coded = corpus_pipeline.STAGES[-1][1](spark, before, SF_SMALL)
    assert coded.count() == before.count()


def test_near_copies_leave_one(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:100 + i % 3] + words[100 + i % 3:]), "en", "s", 1) for i in range(5)] + [(9, " ".join(words[::-1]), "en", "s", 1), (9, " ".join(words[::-1]), "en", "s", 1)]
    rows += [(7, " ".join([*words[:-1], "other"]), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, df, SF_SMALL).collect()) == [0, 9]


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF_SMALL)
    assert {"doc_id", "n_tokens", "ids"} <= set(rows.columns) and rows.count() > 50


def test_short_lines_keep_their_document(spark):
    footer = "this footer is shared by many documents"
    poem = "\n".join(f"line {i}" for i in range(100))
    rows = [(i, t, "en", "s", len(t)) for i, t in [(1, f"first\n{footer}"), (2, f"{poem}\n{footer}"), (3, f"短い行\n{footer}"), (4, f" \t\n\u00a0\u200b\n{footer}"), (5, footer)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, df, SF_SMALL).collect()}
    assert out == {1: (f"first\n{footer}", len(footer) + 6), 2: (poem, len(poem)), 3: ("短い行", 3)}


def test_empty_documents_and_clashing_columns(spark):
    rows = [(i, f"the cat and the dog {i} walk home " * 4, "en", "s", 1, "x", "y", "z") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, p_times string, g_no string")
    for docs in (df, df.where("doc_id < 0")):
        before = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stored(stage(spark, before, SF_SMALL), name)
            assert after.columns == df.columns and all((r.lang_pred, r.p_times, r.g_no) == ("x", "y", "z") for r in after.collect())
            before = after
        assert corpus_pipeline.STAGES[-1][1](spark, before, SF_SMALL).count() == before.count()
