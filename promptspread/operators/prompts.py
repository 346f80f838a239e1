"""Prompt construction (D1-D6): fill templates, demo blocks, full prompts, messages, perturbations.

Formats belong to tasks, so prompts are an equi-join of instances with their
task's (few) formats - never a cross product.  Hole filling interleaves the
template pieces with the fields via ``zip_with``: field text containing ``{}``
is never re-substituted (a sequential ``replace`` would be wrong).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the reference).
INSTRUCTION_TAG = "<input>"
RESPONSE_TAG = "<robustness_on>"
SYSTEM_SUFFIX = " PAY ATTENTION TO THE OUTPUT FORMAT -- ONLY OUTPUT THE ANSWER WITHOUT ANY OTHER TEXT, LIKE IN EXAMPLES."
BLOCK_SEP = "\n\n"


def fill_template(template: Column, fields: Column) -> Column:
    """``template.format(*fields)`` for ``{}`` holes.

    Pieces p0..pn and fields f1..fn interleave as p0 f1 p1 ... fn pn; a missing
    field leaves its hole empty (the reference warns about the count mismatch).
    """
    pieces = F.split(template, "\\{\\}", -1)
    padded = F.concat(fields, F.array_repeat(F.lit(""), F.greatest(F.size(pieces) - 1 - F.size(fields), F.lit(0))))
    joined = F.zip_with(F.slice(pieces, 2, 1 << 30), padded, lambda p, f: F.concat(f, p))
    return F.concat(pieces[0], F.array_join(joined, ""))


def hole_mismatch(template: Column, fields: Column) -> Column:
    """D1 audit: hole count differs from field count."""
    return (F.size(F.split(template, "\\{\\}", -1)) - 1) != F.size(fields)


def demo_block(definition: Column, demos: Column) -> Column:
    """Definition + blank line + demonstrations joined by blank lines (``demos`` ordered)."""
    return F.concat(definition, F.lit(BLOCK_SEP), F.array_join(demos, BLOCK_SEP))


def full_prompt(block: Column, filled_input: Column, n_shot: int) -> Column:
    """D3: zero-shot = the bare formatted input; otherwise demo block + blank line + input."""
    return filled_input if n_shot == 0 else F.concat(block, F.lit(BLOCK_SEP), filled_input)


def to_messages(prompt: Column) -> Column:
    """First blank-line part = system (+ fixed suffix); the rest joined = user."""
    parts = F.split(prompt, BLOCK_SEP, -1)
    n = F.size(parts)
    demos = F.slice(parts, 2, F.greatest(n - 2, F.lit(0)))
    user = F.concat(F.array_join(demos, BLOCK_SEP), F.lit(BLOCK_SEP), F.element_at(parts, -1))
    return F.array(F.struct(F.lit("system").alias("role"), F.concat(parts[0], F.lit(SYSTEM_SUFFIX)).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def vocabulary(df: DataFrame, text: str, size: int) -> list[str]:
    """``size`` of the tokens that occur in the texts, by digest order, so that the choice depends on no partitioning."""
    tokens = df.select(F.explode(F.split(F.col(text), " ")).alias("token")).distinct()
    return [r["token"] for r in tokens.orderBy(F.md5("token"), "token").limit(size).collect()]   # at most ``size``


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 32-bit numbers over 32 bits, one to one (products wrap around)."""
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(73244475)
    return x ^ (x >> np.uint32(16))


def _numbers(key: str, places: np.ndarray) -> np.ndarray:
    """Different 32-bit numbers for these places, which follow from the key."""
    return _mixed(places * np.uint32(2654435761) + np.uint32(int(hashlib.md5(key.encode()).hexdigest()[:8], 16)))


def perturbed(text: str, keys: list[str], pct: float, words: list[str]) -> list[tuple[str, int, int]]:
    """For each key the text with floor(n * pct) of its n tokens replaced, n and that number.  The places with the smallest
    keyed numbers are taken (a selection, no sort), so their number is exact; the new tokens come from ``words``."""
    tokens = text.split(" ")
    n = len(tokens)
    k = int(n * pct)
    every, out = np.arange(n, dtype=np.uint32), []
    for key in keys:
        copy = tokens.copy()
        if k and words:
            places = np.argpartition(_numbers(key, every), k - 1)[:k]
            picks = _numbers(key + "|v", places.astype(np.uint32)) % np.uint32(len(words))
            for i, w in zip(places.tolist(), picks.tolist()):
                copy[i] = words[w]
        out.append((" ".join(copy), n, k))
    return out


def with_perturbed(df: DataFrame, text: str, keys: list[str], copies: int, pct: float, words: list[str], keep: list[str] | None = None) -> DataFrame:
    """Every row once for each copy (``copy_id`` from 1), with its perturbed text, tokens and replaced tokens.

    ``keys`` are the string keys of a row; a copy's key is them and its number.  The
    copies are made where the text is: prompts hold whole demonstrations, and are
    neither copied through a shuffle nor exploded into tokens.  ``keep`` are the
    columns of the rows to return (default: all); the text itself would come back
    once for each copy.
    """
    own = [f for f in df.schema.fields if keep is None or f.name in keep]
    df = df.select(*{c: None for c in [*(f.name for f in own), text, *keys]})   # nothing else goes to Python
    schema = T.StructType([*own, T.StructField("copy_id", T.IntegerType()), T.StructField("perturbed", T.StringType()),
                           T.StructField("n_tokens", T.IntegerType()), T.StructField("n_replaced", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                rows = list(zip(batch.column(text).to_pylist(), *(batch.column(k).to_pylist() for k in keys)))
                numbered = range(1, copies + 1)
                out = [(c, *one) for t, *key in rows for c, one in zip(numbered, perturbed(t or "", ["|".join([*map(str, key), str(c)]) for c in numbered], pct, words))]
                again = batch.select([f.name for f in own]).take(pa.array(np.repeat(np.arange(batch.num_rows), copies)))
                columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*again.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)
