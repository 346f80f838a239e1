"""Operator 1, language ID: a byte convolutional network trained here, applied to fixed-length windows.

Network: byte embedding -> convolution filters of several widths -> max pooling
over the window -> ReLU -> softmax layer.  All widths run as one matrix product
(narrow filters are zero-padded), and because max pooling passes the gradient
through one position per filter only, the backward pass touches those positions
alone.  Training uses a sample of at most ``per_lang`` windows per language
(``Settings``); prediction reads every byte of every text: a text is cut into
windows of ``window`` bytes, windows of many texts are scored as one batch, and
a text's class is the byte-weighted mean of its windows' log probabilities.

For prediction the trained weights are rounded to whole numbers small enough for
every sum of products to be exact (below 2 ** 24 in the convolution, 2 ** 53 in
the softmax layer).  A window's responses therefore don't depend on the batch it
is scored in, nor on the order in which a library adds.

Defined results: null, empty and letterless texts are ``und`` with score 0;
with no labelled row at all everything is ``und``.  Repeated rows have equal
results on any partitioning, and a tie goes to the language first in code point
order.  Extra columns pass through; an input column named like
an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptspread.llm.common import slices, unused, utf8

UNDETERMINED = "und"
PAD = 256  # embedding row of positions beyond the end of a text; all zeros


@dataclass(frozen=True)
class Settings:
    window: int = 256          # bytes per window
    dim: int = 8               # embedding size
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 8           # per width
    per_lang: int = 1000       # bound of the training sample: windows per language
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 7
    block: int = 128           # windows per matrix product when predicting


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    embedding: np.ndarray      # (257, dim), whole numbers as float32
    kernel: np.ndarray         # (max width * dim, filters of all widths), whole numbers as float32
    bias: np.ndarray           # whole numbers as float32
    out: np.ndarray            # (filters of all widths, languages), whole numbers as float64
    unit: float                # what one in a product with ``out`` stands for
    out_bias: np.ndarray
    settings: Settings


def quantised(languages: tuple[str, ...], emb: np.ndarray, kernel: np.ndarray, bias: np.ndarray, out: np.ndarray, out_bias: np.ndarray, s: Settings) -> Model:
    """Weights rounded so that all sums of products are exact: 2 ** 24 bounds the convolution with bias, 2 ** 53 the layer on top."""
    def whole(x: np.ndarray, largest: int) -> tuple[np.ndarray, float]:
        unit = float(np.abs(x).max(initial=0)) / largest or 1.0
        return np.rint(x / unit), unit

    e, e_unit = whole(emb.astype(np.float64), 127)
    k, k_unit = whole(kernel.astype(np.float64), (1 << 23) // (127 * len(kernel)))
    b = np.clip(np.rint(bias / (e_unit * k_unit)), -(1 << 23), 1 << 23)
    o, o_unit = whole(out.astype(np.float64), (1 << 53) // ((1 << 24) * max(1, len(out))))
    return Model(languages, e.astype(np.float32), k.astype(np.float32), b.astype(np.float32), o, e_unit * k_unit * o_unit, out_bias.astype(np.float64), s)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _positions(tokens: np.ndarray, embedding: np.ndarray, width: int) -> np.ndarray:
    """(windows, positions, width * dim): the embedded bytes under a filter at every position."""
    emb = embedding[tokens]
    n, length, dim = emb.shape
    s0, s1, s2 = emb.strides
    view = np.lib.stride_tricks.as_strided(emb, (n, length - width + 1, width * dim), (s0, s1, s2))
    return np.ascontiguousarray(view)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray, window: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts into windows: (tokens with ``pad`` closing positions, row of each window, bytes in each window)."""
    lengths = np.diff(offsets)
    count = np.maximum(1, -(-lengths // window))
    row = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + nth * window
    size = np.minimum(window, offsets[row + 1] - start)
    at = start[:, None] + np.arange(window + pad)
    inside = np.arange(window + pad) < size[:, None]
    padded = np.append(data, np.uint8(0)).astype(np.int16)  # wide enough for PAD
    tokens = np.where(inside, padded[np.minimum(at, len(data))], np.int16(PAD))
    return tokens, row, size


def gradients(x: np.ndarray, y: np.ndarray, params: list[np.ndarray], mask: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy of windows ``x`` with classes ``y``, in the order of the parameters."""
    emb, kernel, bias, out, out_bias = params
    n, k, dim = len(x), kernel.shape[1], emb.shape[1]
    widest = len(kernel) // dim
    cols = _positions(x, emb, widest)
    conv = (cols.reshape(-1, cols.shape[2]) @ kernel).reshape(n, -1, k)
    at = conv.argmax(axis=1)
    pooled = np.take_along_axis(conv, at[:, None, :], 1)[:, 0] + bias
    h = np.maximum(pooled, 0)
    p = _softmax(h @ out + out_bias)
    p[np.arange(n), y] -= 1
    p /= n
    dh = (p @ out.T) * (pooled > 0)
    best = np.take_along_axis(cols, at[:, :, None], 1)                  # (batch, filters, widest * dim)
    d_kernel = np.einsum("bk,bkc->ck", dh, best) * mask
    d_cols = (dh[:, :, None] * kernel.T[None]).reshape(n, k, widest, dim)
    d_emb = np.zeros_like(emb)
    where = np.take_along_axis(x[:, None, :].repeat(k, 1), at[:, :, None] + np.arange(widest), 2)
    np.add.at(d_emb, where.reshape(-1), d_cols.reshape(-1, dim))
    d_emb[PAD] = 0
    return [d_emb, d_kernel, dh.sum(0), h.T @ p, p.sum(0)]


def fit(texts: list[bytes], labels: list[str], settings: Settings = Settings()) -> Model:
    """Train on labelled windows in numpy with Adam; every window also appears cut short, for short texts."""
    s = settings
    languages = tuple(sorted(set(labels)))
    rng = np.random.default_rng(s.seed)
    widest, k = max(s.widths), s.filters * len(s.widths)
    offsets = np.concatenate([[0], np.cumsum([min(len(t), s.window) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(t[:s.window] for t in texts), np.uint8)
    tokens, _, size = windows(data, offsets, s.window, widest - 1)
    y = np.searchsorted(languages, labels)

    emb = rng.normal(0, 0.5, (PAD + 1, s.dim)).astype(np.float32)
    emb[PAD] = 0
    mask = np.concatenate([np.repeat((np.arange(widest) < w), s.dim)[:, None].repeat(s.filters, 1) for w in s.widths], axis=1).astype(np.float32)
    kernel = (rng.normal(0, 0.3, (widest * s.dim, k)) * mask).astype(np.float32)
    bias = np.zeros(k, np.float32)
    out = rng.normal(0, 0.1, (k, len(languages))).astype(np.float32)
    out_bias = np.zeros(len(languages), np.float32)
    params = [emb, kernel, bias, out, out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), s.batch):
            pick = order[lo:lo + s.batch]
            x = tokens[pick].copy()
            cut = np.where(rng.random(len(pick)) < 0.4, rng.integers(8, 80, len(pick)), s.window)
            x[np.arange(x.shape[1]) >= cut[:, None]] = PAD
            steps = gradients(x, y[pick], params, mask)
            step += 1
            for q, g, (m, v) in zip(params, steps, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= s.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return quantised(languages, emb, kernel, bias, out, out_bias, s)


def train(df: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model | None:
    """Fit on a sample of at most ``settings.per_lang`` windows per language; None without labelled text.

    The sample takes, per language, the distinct texts with the smallest hash and
    from each one window that starts at a place chosen by the hash.  The languages'
    numbers of distinct texts with a letter give a hash limit that about three
    times the sample passes, however many copies there are; only text hashes are
    shuffled for them, and no task of a common language grows with the data.
    """
    s = settings
    labelled = df.where(F.col(f"`{lang}`").isNotNull() & has_letter(F.col(f"`{text}`")))
    h = F.xxhash64(F.col(f"`{text}`"), F.lit(s.seed))
    distinct = labelled.select(F.col(f"`{lang}`").alias("l"), h.alias("h")).distinct()
    counts = {r.l: r["count"] for r in distinct.groupBy("l").count().collect()}  # one row per language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, 3 * s.per_lang / n))])
    places = F.greatest(F.length("t") - F.lit(s.window // 2), F.lit(1))
    sample = (
        labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"), h.alias("h"))
        .where(F.col("h") / float(1 << 64) + 0.5 <= F.element_at(share, F.col("l")))
        .select("l", "h", F.substring("t", F.pmod("h", places).cast("int") + 1, F.lit(s.window)).alias("t"))
        .distinct()
        .withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "t")))
        .where(F.col("n") <= s.per_lang)
        .orderBy("l", "h", "t")
        .select("t", "l")
    )
    rows = sample.collect()  # at most per_lang windows for each language
    return fit([r.t.encode() for r in rows], [r.l for r in rows], settings) if rows else None


def log_probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages): byte-weighted mean over a text's windows of their log probabilities."""
    s = model.settings
    widest = max(s.widths)
    lengths = np.diff(offsets)
    total = np.zeros((len(lengths), len(model.languages)))
    # rows whose windows make up a few blocks at a time; a long text is cut into pieces of whole windows
    piece = s.window * s.block
    count = np.maximum(1, -(-lengths // piece))
    owner = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[owner] + nth * piece
    end = np.minimum(begin + piece, offsets[owner + 1])
    weight = np.maximum(1, -(-(end - begin) // s.window))
    group = np.cumsum(weight) // s.block
    for g in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(group)) + 1):
        if not len(g):
            continue
        size = end[g] - begin[g]
        local = np.concatenate([[0], np.cumsum(size)])
        chunk = np.concatenate([data[a:b] for a, b in zip(begin[g], end[g])]) if local[-1] else np.zeros(0, np.uint8)
        x, row, nbytes = windows(chunk, local, s.window, widest - 1)
        cols = _positions(x, model.embedding, widest)
        conv = (cols.reshape(-1, cols.shape[2]) @ model.kernel).reshape(len(x), -1, model.kernel.shape[1])
        h = np.maximum(conv.max(axis=1) + model.bias, 0)
        z = (h.astype(np.float64) @ model.out) * model.unit + model.out_bias
        z -= z.max(axis=1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        np.add.at(total, owner[g][row], logp * nbytes[:, None])
    return total / np.maximum(lengths, 1)[:, None]


def predict(df: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` plus the language and its probability; one pass, no shuffle."""
    clash = {pred.lower(), score.lower()}
    letter = unused([*df.columns, pred, score, text], "has_letter")
    body = unused([*df.columns, pred, score, letter], "body")
    kept = [c for c in df.columns if c.lower() not in clash]
    source = df.select(*[F.col(f"`{c}`") for c in kept], has_letter(F.col(f"`{text}`")).alias(letter), F.col(f"`{text}`").alias(body))
    fields = [f for f in df.schema.fields if f.name.lower() not in clash]
    schema = T.StructType([*fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, body):
                n = batch.num_rows
                names, scores = np.full(n, UNDETERMINED, object), np.zeros(n)
                if model is not None and n:
                    logp = log_probabilities(model, *utf8(batch.column(body)))
                    p = _softmax(logp)
                    good = batch.column(letter).to_numpy(zero_copy_only=False).astype(bool)
                    best = p.argmax(axis=1)
                    names = np.where(good, np.array(model.languages, object)[best], names)
                    scores = np.where(good, p[np.arange(n), best], 0.0)
                out = [batch.column(c) for c in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(out, names=[*kept, pred, score])

    return source.mapInArrow(run, schema)


def identify(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", settings: Settings = Settings(),
             pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Train on the rows where ``learn`` holds, predict for all rows from their text alone."""
    return predict(df, train(df.where(learn), text, lang, settings), text, pred, score)
