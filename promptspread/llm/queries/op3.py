"""op3: fingerprints of every document and of its text edited with the next document.

The next document follows in descending doc_id (after the last: the first).  All
documents are dealt once into ranges of doc_id; the first document of each range
also goes, as a guest, to the range before it, so each range holds all its
neighbours and no document needs a second shuffle.  Ties of doc_id are ordered
by text; documents without doc_id come last, ordered by a hash of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptspread.llm import minhash
from promptspread.llm.common import parallelism, slices
from promptspread.llm.registry import register
from promptspread.sources.tables import table

NULL_RANGES = 64
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _range_of(value: Column, splits: list[float]) -> Column:
    """Number of splits at or below a value, by binary search."""
    n = len(splits)
    if not n:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    bounds = F.array(*[F.lit(float(x)) for x in splits])
    step = lambda low, s: F.when((low + s <= n) & (F.try_element_at(bounds, low + s) <= value), low + s).otherwise(low)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def in_ranges(docs: DataFrame) -> DataFrame:
    """(place, guest, key, doc_id, text), dealt and sorted so that every document's successor is the next row."""
    spark = docs.sparkSession
    n = 4 * parallelism(spark)
    splits = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) or []))
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    place = F.when(F.col("doc_id").isNotNull(), _range_of(F.col("doc_id").cast("double"), splits)).otherwise(
        -1 - F.pmod(F.xxhash64("text"), F.lit(NULL_RANGES)).cast("int"))
    rows = docs.select(place.alias("place"), key.alias("key"), "doc_id", "text")
    heads = rows.groupBy("place").agg(F.max("key").alias("key")).collect()  # one small row for each range
    heads = sorted(heads, key=lambda r: -r.place)
    host = {r.place: heads[i - 1].place for i, r in enumerate(heads)}  # the range that a range's first document visits
    first = {r.place: r.key for r in heads}
    if not heads:
        return rows.withColumn("guest", F.lit(False))
    lookup = lambda m: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("place"))
    own = F.struct(F.col("place").alias("place"), F.lit(False).alias("guest"))
    visit = F.struct(lookup(host).alias("place"), F.lit(True).alias("guest"))
    to = F.explode(F.when(F.col("key") == lookup(first), F.array(own, visit)).otherwise(F.array(own)))
    dealt = rows.withColumn("to", to).select("to.place", "to.guest", "key", "doc_id", "text")
    return dealt.repartition(parallelism(spark), "place").sortWithinPartitions("place", "guest", F.desc("key"), "text")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted ranges; the last row of a slice waits for its successor in the next one."""
    waiting = None  # (place, doc_id, text, fingerprint)
    for whole in batches:
        for batch in slices(whole, "text"):
            place, guest, ids = (batch.column(c).to_pylist() for c in ("place", "guest", "doc_id"))
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = list(zip(place, ids, texts, _prints(texts)))
            pairs = []
            for row, visits in zip(rows, guest):
                if waiting is not None:
                    pairs.append((waiting, row))
                waiting = None if visits else row
                # after its first guest a range is done; further guests (ties) follow nothing
            yield _result(pairs)


def _prints(texts: list[str]) -> list[bytes]:
    raw = [t.encode() for t in texts]
    return minhash.sketch(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _result(pairs: list) -> pa.RecordBatch:
    changed = [edited(a[2], b[2]) for a, b in pairs]
    prints = _prints(changed)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([a[1] for a, _ in pairs], pa.int64()),
        "n_chars": pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
        "fingerprint": pa.array([a[3].hex() for a, _ in pairs], pa.string()),
        "edited_fingerprint": pa.array([p.hex() for p in prints], pa.string()),
        "near_edited": pa.array([minhash.likeness(a[3], p) for (a, _), p in zip(pairs, prints)], pa.float64()),
        "near_next": pa.array([minhash.likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
    })


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    return in_ranges(docs.select("doc_id", "text")).select("place", "guest", "doc_id", "text").mapInArrow(_edit, RESULT)


@register("op3_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
