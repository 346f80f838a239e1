"""Shared helpers of the training-data operators: shared-folder tables, Arrow text access, unused names."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptspread.session import shared_path

# Word of a text for every word-based operator: a run of anything but the six ASCII white spaces.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# Near duplicates: shingles of five words, Jaccard similarity of 80 % or more.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder nobody else uses, inside the shared folder of the session (``spark.checkpoint.dir``)."""
    return shared_path(spark, f"promptspread-{uuid.uuid4().hex}/{name}")


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for; operators that place rows themselves use the same number."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until it clashes with none of ``taken`` (case-insensitively)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def with_outputs(df: DataFrame, **outputs: Column) -> DataFrame:
    """Add output columns; input columns that clash with an output name are replaced by it."""
    names = {n.lower() for n in outputs}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*keep, *[c.alias(n) for n, c in outputs.items()])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the ``n + 1`` offsets of its values; null counts as empty."""
    col = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, budget: int = 4_000_000) -> Iterable[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``budget`` bytes, so that memory does not follow batch size."""
    _, offsets = utf8(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + budget, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
