"""Operator 3, document fingerprints by one-permutation MinHash.

Each shingle is hashed once; the high bits choose a bin and the bin keeps its
smallest hash.  Empty bins are filled by optimal densification: every empty bin
follows its own fixed random sequence of bins and copies the first one that a
shingle filled.  Of each bin only the low ``bits`` bits are stored, packed.  Two
unrelated bins then agree by chance with probability ``2 ** -bits``; ``likeness``
takes that bias out.

Defined results: null and empty texts, and texts without a word, have the empty
fingerprint; it is like itself (1) and unlike all others (0).  Equal texts have
equal fingerprints, so repeated rows do too.  Texts of any length are read
whole, in slices.  Extra columns pass through; an input column named like the
output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptspread.llm.common import SHINGLE_WORDS, slices, unused, utf8
from promptspread.llm.shingles import mix, shingles

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    bins: int = 512   # a power of two
    bits: int = 4     # stored of each bin: 1, 2, 4 or 8
    words: int = SHINGLE_WORDS
    seed: int = 11


@lru_cache(1024)
def _jump(settings: Settings, attempt: int) -> np.ndarray:
    """For every bin, the bin that its sequence visits at this attempt."""
    at = np.arange(settings.bins, dtype=np.uint64) + np.uint64(settings.bins * attempt) + np.uint64(settings.seed << 40)
    return (mix(mix(at)) % np.uint64(settings.bins)).astype(np.int64)


def densify(table: np.ndarray, settings: Settings) -> np.ndarray:
    """Fill the empty bins of every row that has a filled one."""
    filled = table != EMPTY
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out, attempt = table.copy(), 0
    while len(row):
        source = _jump(settings, attempt)[col]
        hit = filled[row, source]
        out[row[hit], col[hit]] = table[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
        attempt += 1
    return out


def sketch(data: np.ndarray, offsets: np.ndarray, settings: Settings = Settings(), rows: int = 1024) -> list[bytes]:
    """Packed fingerprint of each text; ``rows`` texts share a table of bins at a time."""
    s, out = settings, []
    shift = np.uint64(64 - (s.bins.bit_length() - 1))
    for lo in range(0, len(offsets) - 1, rows):
        part = offsets[lo:lo + rows + 1]
        h, row = shingles(data[part[0]:part[-1]], part - part[0], s.words)
        table = np.full((len(part) - 1, s.bins), EMPTY)
        h = mix(h ^ np.uint64(s.seed))
        np.minimum.at(table.reshape(-1), row * s.bins + (h >> shift).astype(np.int64), h & ((np.uint64(1) << shift) - np.uint64(1)))
        some = np.bincount(row, minlength=len(part) - 1) > 0
        # mixed with the bin, so that copies of one unequal value agree by chance bin by bin, not all at once
        spread = mix(densify(table, s) + np.arange(s.bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        low = (spread & np.uint64((1 << s.bits) - 1)).astype(np.uint8)
        per_byte = 8 // s.bits
        packed = np.zeros((len(low), s.bins // per_byte), np.uint8)
        for i in range(per_byte):
            packed |= low[:, i::per_byte] << np.uint8(i * s.bits)
        out += [p.tobytes() if full else b"" for p, full in zip(packed, some)]
    return out


@lru_cache(1)
def _equal_bins(bits: int) -> np.ndarray:
    """For the exclusive or of two packed bytes: how many of the bins in them agree."""
    x = np.arange(256)
    return sum(((x >> shift) & ((1 << bits) - 1) == 0).astype(np.int64) for shift in range(0, 8, bits))


def likeness(a: bytes, b: bytes, settings: Settings = Settings()) -> float:
    """Estimated Jaccard similarity: the share of agreeing bins, without the agreement of chance, from 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    equal = _equal_bins(settings.bits)[np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)].sum() / settings.bins
    chance = 2.0 ** -settings.bits
    return float(min(1.0, max(0.0, (equal - chance) / (1 - chance))))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", settings: Settings = Settings()) -> DataFrame:
    """``df`` plus the fingerprint of each text as lower-case hex; no shuffle."""
    body = unused([*df.columns, out], "body")
    kept = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([f for f in df.schema.fields if f.name.lower() != out.lower()] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, body):
                prints = [p.hex() for p in sketch(*utf8(batch.column(body)), settings)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(prints, pa.string())], names=[*kept, out])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(body)).mapInArrow(run, schema)
