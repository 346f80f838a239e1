"""Training-corpus pipeline: each stage applies one operator to all rows that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptspread.llm import bpe, lang_id, line_dedup, mixing, ngram_join
from promptspread.llm.common import stored, unused
from promptspread.llm.queries.op1 import held_out
from promptspread.llm.queries.op2 import vocabulary_path
from promptspread.llm.queries.op7 import quality
from promptspread.sources.tables import table

ORACLE_SQL: str | None = None  # training a network, and encoding, have no SQL form


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: a document in which no language can be told (no letter in it) goes, all others stay as they are."""
    model = lang_id.train(docs.where(~held_out()))
    pred, score = unused(docs.columns, "lang_pred"), unused(docs.columns, "lang_score")
    seen = lang_id.predict(docs, model, pred=pred, score=score)
    return seen.where(F.col(pred) != lang_id.UNDETERMINED).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of equal lines the first stays, a line near a kept one goes; a document that loses lines and has no visible character left goes."""
    return line_dedup.dedup(docs, keep_short=True).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the first document of every group of near copies stays."""
    k, h, n = (unused(docs.columns, name) for name in ("k", "h", "n"))
    kept = ngram_join.join(docs).where("keeper").select(_key(F.col("doc_id")).alias(k), F.col("h").alias(h)).distinct()
    rows = docs.withColumn(k, _key(F.col("doc_id"))).withColumn(h, F.xxhash64("text")).join(kept, [k, h], "left_semi")
    # of rows equal in id and text the one smallest in its other columns, so that reruns agree
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    one = rows.withColumn(n, F.row_number().over(Window.partitionBy(k, h).orderBy(*rest))).where(F.col(n) == 1)
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])


def _key(id_):
    return F.coalesce(id_.cast("string"), F.lit("null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its source's target takes it."""
    return mixing.repeated(docs, mixing.mix(docs, quality=quality(spark, sf_dir)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: the token ids of every row of the mix."""
    coded = bpe.encode(docs, bpe.build(docs, vocabulary_path()))
    return coded.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's rows are written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
