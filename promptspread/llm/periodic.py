"""Operator 13, periodic runs in the word sequence of a text, by string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are identical),
at least ``exponent`` periods and ``least`` words long, that no neighbouring word
extends.  Runs are found scale by scale, t = 1, 2, 4, ...; scale t finds the
periods from t to 2t - 1:

* Every place gets a hash of its t words.  A place belongs to the scale's
  synchronising set if the smallest hash among the places from it to t further is
  its own or that of the place t further.  Whether it belongs depends on its next
  2t words alone, so equal contexts are chosen alike wherever they stand.
* Places whose t words repeat a period of at most t / 4 take no part; these highly
  periodic regions are the runs that smaller scales have found, and their periods
  are known.  Elsewhere the set has a place in any t neighbouring ones.
* Inside a run of period q a place of the set therefore comes again q words later
  with the same 2t words, and none of the places between has them.  So next
  places with equal contexts, t to 2t - 1 apart, propose all periods.
* A proposed period is checked word by word in its text, which yields the text's
  maximal stretches of that period; a stretch found with a smaller period before
  is dropped, since that period divides the new one.

All texts of a slice are one sequence with marks between them, so a scale costs a
few array operations; a text leaves the sequence when it is too short for a scale.

Defined results: null and empty texts, and texts without a word, have no run, an
empty collapsed text and null for the strongest run.  Ties for the strongest run
go to the smallest start, then period.  Texts of any length are read whole; a
long text is a slice of its own.  Repeated rows and null ids are rows like any
other; an empty table gives an empty result.  Extra columns pass through; input
columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptspread.llm.common import WORD_PATTERN, slices, unused
from promptspread.llm.shingles import mix

NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
WORDS = re.compile(WORD_PATTERN.encode())
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True)
class Settings:
    least: int = 6      # words of a run
    exponent: int = 4   # periods of a run; 4 or more, which the choice of scales relies on


def _later(values: np.ndarray, by: int, fill: np.uint64 = NEVER) -> np.ndarray:
    """The value ``by`` places further on, ``fill`` beyond the end."""
    out = np.full(len(values), fill, values.dtype)
    if by < len(values):
        out[:len(values) - by] = values[by:]
    return out


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each place's ``width`` values from itself on."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out, _later(out, step))
        have += step
    return out


def synchronising(hashes: np.ndarray, scale: int, omitted: np.ndarray) -> np.ndarray:
    """Numbers of the chosen places, given the hash of every place's ``scale`` words and the places that take no part."""
    order = mix(hashes ^ np.uint64(0x8CB92BA72F3D8DD7)) >> np.uint64(1)
    order[omitted] = NEVER
    low = _lowest(order, scale + 1)
    return np.flatnonzero((low != NEVER) & ((low == order) | (low == _later(order, scale))))


def _stretches(words: np.ndarray, period: int, exponent: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches of this period that hold ``exponent`` of them."""
    same = np.zeros(len(words) - period + 2, np.int8)
    same[1:-1] = words[:-period] == words[period:]
    edge = np.flatnonzero(np.diff(same))
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= (exponent - 1) * period
    return [(int(a), int(b - a) + period) for a, b in zip(start[long], stop[long])]


def find(texts: list[np.ndarray], settings: Settings = Settings()) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each word-number sequence, by start, then period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    k = settings.exponent
    live = np.array([i for i, t in enumerate(texts) if len(t) >= k], np.int64)
    if not len(live):
        return [[] for _ in texts]
    size = np.array([len(texts[i]) for i in live], np.int64)
    # one sequence; the mark behind each text occurs nowhere else
    sequence = np.concatenate([np.append(texts[i], -1 - j) for j, i in enumerate(live)])
    hashes = mix(sequence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    scale = 1
    while len(live):
        base = np.cumsum(size + 1) - (size + 1)
        omitted = np.zeros(len(hashes) + 1, np.int32)
        for at, i in zip(base.tolist(), live.tolist()):
            for (start, length), period in found[i].items():
                if k * period <= scale <= length:
                    omitted[at + start] += 1
                    omitted[at + start + length - scale + 1] -= 1
        chosen = synchronising(hashes, scale, np.cumsum(omitted[:-1]) > 0)
        # the hash of twice as many words; places near the end have none and get one of their own
        further = _later(hashes, scale)
        double = mix(hashes * np.uint64(0xD6E8FEB86659FD93) + further + np.uint64(scale))
        tail = max(0, len(hashes) - scale)
        double[tail:] = mix(np.arange(tail, len(hashes), dtype=np.uint64) ^ np.uint64(scale << 40))
        context = double[chosen]
        order = np.argsort(context, kind="stable")
        place, context = chosen[order], context[order]
        apart = np.diff(place)
        near = (context[1:] == context[:-1]) & (apart >= scale) & (apart < 2 * scale)
        text = np.searchsorted(base, place[:-1][near], side="right") - 1
        for period, j in np.unique(np.stack([apart[near], text], axis=1), axis=0).tolist():
            i = int(live[j])
            if k * period <= len(texts[i]):
                for stretch in _stretches(texts[i], period, k):
                    found[i].setdefault(stretch, period)
        scale *= 2
        stay = size >= k * scale
        hashes = double[np.repeat(stay, size + 1)]
        live, size = live[stay], size[stay]
    return [sorted((a, n, q) for (a, n), q in runs.items() if n >= settings.least) for runs in found]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, exactly; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def detect(df: DataFrame, text: str = "text", runs: str = "runs", top: str = "strongest", out: str = "collapsed", settings: Settings = Settings()) -> DataFrame:
    """``df`` plus each text's runs, its strongest run and the text without repetitions; one pass, no shuffle."""
    outputs = [runs, top, out]
    clash = {o.lower() for o in outputs}
    body = unused([*df.columns, *outputs], "body")
    kept = [c for c in df.columns if c.lower() not in clash]
    run_type = T.StructType([T.StructField(f.name, T.LongType()) for f in RUN])
    schema = T.StructType([f for f in df.schema.fields if f.name.lower() not in clash]
                          + [T.StructField(runs, T.ArrayType(run_type)), T.StructField(top, run_type), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, body):
                number: dict[bytes, int] = {}
                words = [WORDS.findall((t or "").encode()) for t in batch.column(body).to_pylist()]
                texts = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in words]
                found = find(texts, settings)
                short = [collapsed(ws, rs).decode() for ws, rs in zip(words, found)]
                flat = np.array([r for rs in found for r in rs], np.int64).reshape(-1, 3)
                cuts = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                listed = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(RUN)))
                best = [strongest(rs) for rs in found]
                best = pa.array([None if b is None else dict(zip(("start", "length", "period"), b)) for b in best], RUN)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), listed, best, pa.array(short, pa.string())], names=[*kept, *outputs])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(body)).mapInArrow(run, schema)
