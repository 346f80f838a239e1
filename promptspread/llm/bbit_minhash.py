"""Operator 11, near-duplicate groups by b-bit MinHash.

Every text becomes the set of its word shingles; texts with equal sets are one
set from then on.  ``hashes`` random orders give each set its minima.

* Signature: of each minimum only ``bits`` low bits are kept, packed into 64-bit
  words.  Two signatures are compared by bit counts; ``similarity`` takes out the
  agreement of chance, ``2 ** -bits``.
* Bands: the kept bits of ``rows`` minima in a row are a band, and sets that share
  a band are candidates, named in the first band they share only.  A pair at the
  threshold shares none with probability ``(1 - 0.8 ** rows) ** bands``, 5e-8 with
  the defaults.
* A candidate goes on to the exact check unless its signatures agree in fewer
  places than a pair at the threshold has with probability 1e-7, or the parities
  of both sets' elements, spread over a bitmap, differ in more bits than the sets
  may differ in elements.
* Check: a candidate becomes a link only by the two full sets.

No bucket forms all its pairs up front.  Buckets are cut into blocks of at most
``block`` sets while they are sorted, so one key may hold any share of the rows.
First, every set of a block meets only the block's first set.  Linked sets get a
label by a few steps of taking the smallest label around; equal labels are
connected, and a bucket of one label is finished.  Of other buckets a second round
takes the best candidates that would connect all labels, a third, after labelling
again, all candidates whose labels still differ.  So no link that could join two
components is left out, and no bound on partners, candidates or buckets exists.

Defined results: null texts and texts without a word have the empty set, size 0,
and are linked with nothing; a text with fewer words than a shingle has one
shingle, its whole word sequence.  Texts of any length are read whole.  Repeated
rows and ties share a set.  Ids may repeat or be null: a null id never names a
component, and a component without any id is null and all its rows are kept.
An empty table gives an empty result.  Extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptspread.llm import shingles
from promptspread.llm.common import SIMILARITY_PERCENT, slices, stored, utf8
from promptspread.llm.components import components

MISS = 1e-7       # chance that the signature filter drops a pair at the threshold
PAIRS = "a binary, b binary, g long"


@dataclass(frozen=True)
class Settings:
    words: int = 2
    percent: int = SIMILARITY_PERCENT
    hashes: int = 128     # bands times rows
    rows: int = 4         # minima in a band key
    bits: int = 8         # kept of each minimum: 1, 2, 4 or 8; a band has 8, 16, 32 or 64 of them
    block: int = 1024     # sets of a bucket that are compared with each other at a time
    seed: int = 5


# ------------------------------------------------------------ sets and signatures

def set_id(s: np.ndarray) -> bytes:
    """128 bits of a set: two sums of differently mixed elements."""
    with np.errstate(over="ignore"):
        x, y = shingles.mix(s).sum(dtype=np.uint64), shingles.mix(s ^ np.uint64(0x5BD1E995C2B2AE35)).sum(dtype=np.uint64)
    return np.array([x, y], np.uint64).tobytes()


@lru_cache(4)
def _orders(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """A mask and an odd factor for every random order of the 32-bit shingle values."""
    rng = np.random.default_rng(s.seed)
    return rng.integers(0, 1 << 32, s.hashes, np.uint32), rng.integers(0, 1 << 31, s.hashes, np.uint32) * np.uint32(2) + np.uint32(1)


def minima(h: np.ndarray, begin: np.ndarray, s: Settings) -> np.ndarray:
    """(texts, hashes): per order the smallest value of each run of shingle hashes; runs start at ``begin`` and aren't empty."""
    out = np.empty((len(begin), s.hashes), np.uint32)
    masks, factors = _orders(s)
    values = (shingles.mix(h) >> np.uint64(32)).astype(np.uint32)
    ends = np.append(begin[1:], len(h))
    lo = 0
    while lo < len(begin):  # about 64 Ki values at a time stay in the processor's cache; a long text is one run
        hi = max(lo + 1, int(np.searchsorted(ends, begin[lo] + (1 << 16), side="right")))
        part, local = values[begin[lo]:ends[hi - 1]], begin[lo:hi] - begin[lo]
        held = np.empty_like(part)
        for i in range(s.hashes):
            np.bitwise_xor(part, masks[i], out=held)
            np.multiply(held, factors[i], out=held)
            out[lo:hi, i] = np.minimum.reduceat(held, local)
        lo = hi
    return out


def signatures(low: np.ndarray, s: Settings) -> np.ndarray:
    """(texts, hashes * bits / 64) uint64: the low bits of the spread minima, packed."""
    spread = shingles.mix(low.astype(np.uint64) + np.arange(s.hashes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    kept = spread & np.uint64((1 << s.bits) - 1)
    per = 64 // s.bits
    packed = np.zeros((len(low), s.hashes // per), np.uint64)
    for i in range(per):
        packed |= kept[:, i::per] << np.uint64(i * s.bits)
    return packed


def bands_of(packed: np.ndarray, s: Settings) -> np.ndarray:
    """(texts, bands): the kept bits of each band's minima as one number."""
    return packed.view(np.dtype(f"u{s.rows * s.bits // 8}"))


def band_keys(packed: np.ndarray, s: Settings) -> np.ndarray:
    """(texts, bands) int64: each band mixed with its number."""
    bands = bands_of(packed, s)
    number = shingles.mix(np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return shingles.mix(number ^ bands.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def bitmap(d: np.ndarray) -> bytes:
    """Parity of a set's elements per bit; two to four bits per element, a power of two and at least 64."""
    bits = max(64, 1 << (2 * len(d) - 1).bit_length())
    count = np.bincount((d & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the elements in which two sets differ, from their bitmaps; the longer one is folded."""
    if len(x) < len(y):
        x, y = y, x
    long, size = int.from_bytes(x, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        long = (long >> size) ^ (long & ((1 << size) - 1))
    return (long ^ int.from_bytes(y, "little")).bit_count()


def may_differ(n, m, s: Settings):
    """In how many elements two sets of these sizes may differ at the threshold."""
    return n + m - 2 * -(-s.percent * (n + m) // (100 + s.percent))


def agreeing(x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """In how many of the minima two packed signatures agree, by counting bits."""
    other = x ^ y
    shift = s.bits // 2
    while shift:
        other |= other >> np.uint64(shift)
        shift //= 2
    ones = np.uint64(sum(1 << i for i in range(0, 64, s.bits)))
    return s.hashes - np.bitwise_count(other & ones).sum(axis=-1).astype(np.int64)


def similarity(agree, s: Settings = Settings()):
    """Jaccard similarity estimated from agreeing places, without the agreement of chance."""
    chance = 2.0 ** -s.bits
    return (agree / s.hashes - chance) / (1 - chance)


@lru_cache(4)
def least_agreeing(s: Settings) -> int:
    """Places in which a pair at the threshold agrees at least, but with probability ``MISS``."""
    chance = 2.0 ** -s.bits
    p = chance + (1 - chance) * s.percent / 100
    below, k = 0.0, 0
    while k < s.hashes:
        below += comb(s.hashes, k) * p ** k * (1 - p) ** (s.hashes - k)
        if below > MISS:
            break
        k += 1
    return k


def _profile(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = utf8(batch.column("text"))
                h, row = shingles.shingles(data, offsets, s.words)
                n = batch.num_rows
                cut = np.searchsorted(row, np.arange(n + 1))
                some = np.flatnonzero(np.diff(cut) > 0)
                distinct = [np.unique(h[cut[i]:cut[i + 1]]) for i in some]
                low = minima(h, cut[some], s)
                packed = signatures(low, s)
                sizes, sids, prints, maps = np.zeros(n, np.int64), [None] * n, [None] * n, [None] * n
                for i, d, p in zip(some.tolist(), distinct, packed):
                    sizes[i], sids[i], prints[i], maps[i] = len(d), set_id(d), p.tobytes(), bitmap(d)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("h"), pa.array(sizes), pa.array(sids, pa.binary()), pa.array(prints, pa.binary()),
                    pa.array(maps, pa.binary())], names=["doc_id", "h", "n", "sid", "sig", "bits"])

    return run


# ------------------------------------------------------------------------ buckets

def _band_rows(s: Settings):
    """(sid, sig) -> (band, key, sid) for every band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_words(batch.column("sig")), s) if batch.num_rows else np.zeros((0, 1), np.int64)
            n, bands = keys.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(keys.ravel()),
                                              batch.column("sid").take(pa.array(np.repeat(np.arange(n), bands)))], names=["band", "key", "sid"])

    return run


def _blocks(block: int):
    """Rows sorted by key (then anything) -> the same rows with the number and the first set of their block.

    A block holds at most ``block`` rows of one key.  Rows alone under their key go,
    but for a task's first and last key, which another task may continue.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rest: pa.Table | None = None
        again, opening = False, True  # rest's key has blocks already; nothing was given out yet

        def cut(table: pa.Table, final: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            nonlocal number, again, opening
            key = table.column("key").to_numpy()
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(begin, len(key)))
            stop = len(key) if final else int(begin[-1] + count[-1] // block * block)
            at = np.arange(stop) - np.repeat(begin, count)[:stop]
            keep = np.repeat(count > 1, count)[:stop]
            if opening or again:
                keep[:count[0]] = True
            if final:
                keep[begin[-1]:] = True
            if stop > begin[-1]:  # the last key goes on or ends here, in blocks
                again, opening = True, False
            else:
                again, opening = again and len(begin) == 1, opening and len(begin) == 1
            first = at % block == 0
            of = np.cumsum(first) - 1
            lead = np.flatnonzero(first)[of] if stop else np.zeros(0, np.int64)
            sid = table.column("sid").combine_chunks()
            out = table.slice(0, stop).append_column("block", pa.array(number + of)).append_column("lead", sid.take(pa.array(lead)))
            number += int(first.sum())
            out = out.filter(pa.array(keep)).combine_chunks().to_batches()
            return (out[0] if out else None), table.slice(stop)

        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            if table.num_rows:
                done, rest = cut(table, False)
                if done is not None:
                    yield done
                rest = rest if rest.num_rows else None
        if rest is not None:
            done, _ = cut(rest, True)
            if done is not None:
                yield done

    return run


def _near(s: Settings):
    """Pairs with both sides' size, signature and bitmap -> those that these admit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            good = s.percent * np.maximum(n, m) <= 100 * np.minimum(n, m)
            good &= agreeing(_words(batch.column("sig_a")), _words(batch.column("sig_b")), s) >= least_agreeing(s)
            good &= [apart(x, y) <= d for x, y, d in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), may_differ(n, m, s).tolist())]
            yield batch.select(["a", "b", "g"]).filter(pa.array(good))

    return run


def _words(column: pa.Array) -> np.ndarray:
    """A binary column of equally long values as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def cross_pairs(group: np.ndarray, side: np.ndarray, band: np.ndarray, label: np.ndarray, n: np.ndarray, sig: np.ndarray, bits: list[bytes],
                s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agreeing) of rows sorted by group: the candidates of one group, of both sides and of different labels, in the first band they share.

    Side -1 marks a block compared with itself.
    """
    last = np.searchsorted(group, group, side="right") - 1
    bands = bands_of(sig, s)
    at, step, found = np.arange(len(group)), 1, [(np.zeros(0, np.int64),) * 3]
    while len(at):
        at = at[at + step <= last[at]]
        other = at + step
        good = (label[at] != label[other]) & ((side[at] < 0) | (side[at] != side[other]))
        good &= s.percent * np.maximum(n[at], n[other]) <= 100 * np.minimum(n[at], n[other])
        i, j = at[good], other[good]
        near = (bands[i] == bands[j]).argmax(axis=1) == band[i]
        i, j = i[near], j[near]
        agree = agreeing(sig[i], sig[j], s)
        near = agree >= least_agreeing(s)
        near[near] = [apart(bits[p], bits[q]) <= d for p, q, d in zip(i[near].tolist(), j[near].tolist(), may_differ(n[i[near]], n[j[near]], s).tolist())]
        found.append((i[near], j[near], agree[near]))
        step += 1
    return tuple(np.concatenate(c) for c in zip(*found))


def forest(i: np.ndarray, j: np.ndarray, agree: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Numbers of the best pairs that connect all nodes (a label in a group) which the pairs connect."""
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    order = np.lexsort((-agree, b, a))
    first = np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)) if len(order) else np.zeros(0, bool)
    best = order[first]  # one pair for each two nodes
    best = best[np.argsort(-agree[best], kind="stable")]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for k, x, y in zip(best.tolist(), a[best].tolist(), b[best].tolist()):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            out.append(k)
    return np.array(out, np.int64)


def _cross(s: Settings, spanning: bool):
    """Entries sorted by (x, y), the two blocks that meet: candidate pairs (a, b, g), g being a number of the two blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> pa.RecordBatch:
            x, y, side, band, n = (table.column(c).to_numpy() for c in ("x", "y", "side", "band", "n"))
            sid, label = table.column("sid").combine_chunks(), table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            group = np.cumsum(new)
            i, j, agree = cross_pairs(group, side, band, label, n, _words(table.column("sig").combine_chunks()), table.column("bits").to_pylist(), s)
            if spanning:
                node = np.unique(np.stack([group, label.astype(np.int64)]), axis=1, return_inverse=True)[1].ravel()
                pick = forest(i, j, agree, node)
                i, j = i[pick], j[pick]
            ids = sid.to_pylist()
            g = (shingles.mix(x.astype(np.uint64)) ^ y.astype(np.uint64)).view(np.int64)
            a = [min(ids[p], ids[q]) for p, q in zip(i.tolist(), j.tolist())]
            b = [max(ids[p], ids[q]) for p, q in zip(i.tolist(), j.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(g[i])], names=["a", "b", "g"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            if not table.num_rows:
                continue
            x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
            cut = int(np.flatnonzero((x != x[-1]) | (y != y[-1]))[-1]) + 1 if (x[0], y[0]) != (x[-1], y[-1]) else 0
            if cut:
                yield pairs(table.slice(0, cut))
            rest = table.slice(cut)  # the last group may go on; a group has at most two blocks
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def _confirm(s: Settings):
    """Rows sorted by (a, g, side): a's text, then its partners' texts -> the pairs whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for whole in batches:
            for batch in slices(whole, "text"):
                a, b, side = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("side").to_pylist()
                good = []
                for k, part in enumerate(shingles.sets(*utf8(batch.column("text")), s.words)):
                    if side[k] == 0:
                        target = part
                    else:
                        common = overlap(part, target)
                        if 100 * common >= s.percent * (len(part) + len(target) - common):
                            good.append(k)
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.binary()), pa.array([b[k] for k in good], pa.binary())], names=["a", "b"])

    return run


def _key(id_: Column) -> Column:
    return F.coalesce(id_.cast("string"), F.lit("null"))


def near_labels(edges: DataFrame, name: str, steps: int = 2) -> DataFrame:
    """(sid, label) of every set with a link (a, b): sets with equal labels are connected; not all connected ones have equal labels."""
    each = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    around = stored(each.unionByName(each.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(each.select("u", F.col("u").alias("v"))), f"around_{name}")
    labels = around.groupBy(F.col("u").alias("sid")).agg(F.min("v").alias("label"))
    labels = labels.select("sid", F.least("sid", "label").alias("label"))
    for _ in range(steps):
        ahead = labels.select(F.col("sid").alias("label"), F.col("label").alias("next"))
        labels = labels.join(ahead, "label").select("sid", F.col("next").alias("label"))   # the label's own label
        there = labels.select(F.col("sid").alias("v"), "label")
        labels = around.join(there, "v").groupBy(F.col("u").alias("sid")).agg(F.min("label").alias("label"))
    return stored(labels, f"labels_{name}")


def links(df: DataFrame, id_: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, sets, edges): every row's set, the distinct sets, and confirmed links (a, b) that give the components of all links."""
    s = settings
    docs = df.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("h", F.xxhash64("text"))
    profile = stored(docs.mapInArrow(_profile(s), "doc_id long, h long, n long, sid binary, sig binary, bits binary"), "profile")
    some = profile.where("n > 0")
    sets = stored(some.groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits"),
                                          F.min(F.struct("doc_id", "h")).alias("at"), F.min("doc_id").alias("doc_id")), "sets")

    rows = sets.select("sid", "sig").mapInArrow(_band_rows(s), "band int, key long, sid binary")
    cut = rows.repartitionByRange("key", "sid").sortWithinPartitions("key", "sid").mapInArrow(_blocks(s.block), "band int, key long, sid binary, block long, lead binary")
    blocks = stored(cut, "blocks")
    asked = blocks.select("sid").distinct()
    # whole texts travel once, and only those of sets in a common bucket any further
    where = sets.join(asked, "sid", "left_semi").select(_key(F.col("at.doc_id")).alias("key"), F.col("at.h").alias("h"), "sid")
    found = docs.select(_key(F.col("doc_id")).alias("key"), "h", "text").join(where.hint("merge"), ["key", "h"])
    texts = stored(found.dropDuplicates(["key", "h"]).select("sid", "text"), "texts")
    facts = sets.select("sid", "n", "sig", "bits")

    def side(name: str) -> DataFrame:
        return facts.select(F.col("sid").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"), F.col("bits").alias(f"bits_{name}"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """A pair's texts meet at (a, g), where a's text serves all partners of one block."""
        partners = pairs.join(texts.withColumnRenamed("sid", "b"), "b").select("a", "g", F.lit(1).alias("side"), "b", "text")
        targets = pairs.select("a", "g").distinct().join(texts.withColumnRenamed("sid", "a"), "a").select("a", "g", F.lit(0).alias("side"), F.lit(None).cast("binary").alias("b"), "text")
        both = targets.unionByName(partners).repartition("a", "g").sortWithinPartitions("a", "g", "side", "b")
        return stored(both.mapInArrow(_confirm(s), "a binary, b binary"), name)

    # first round: every set meets the first of its block, the first sets of a bucket's blocks meet in a chain
    star = blocks.where("lead <> sid").select(F.col("lead").alias("a"), F.col("sid").alias("b"), F.col("block").alias("g"))
    leads = blocks.select("key", "lead", "block").distinct()
    chain = leads.selectExpr("lag(lead) OVER (PARTITION BY key ORDER BY block) AS a", "lead AS b", "block AS g").where("a <> b")
    first = star.unionByName(chain).groupBy("a", "b").agg(F.min("g").alias("g"))
    near = stored(first.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near(s), PAIRS), "near")
    edges = confirmed(near, "edges_star")

    def candidates(rows: DataFrame, labels: DataFrame, spanning: bool, name: str) -> DataFrame:
        """The candidate pairs (a, b, g) of blocks of one bucket whose labels differ."""
        now = rows.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        block = now.groupBy("key", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        x, y = (block.select("key", F.col("block").alias(c), F.col("low").alias(f"l{c}"), F.col("high").alias(f"h{c}")) for c in "xy")
        meet = stored(x.join(y, "key").where("x <= y AND NOT (lx = hx AND ly = hy AND lx = ly)").select("x", "y"), f"meet_{name}")
        member = now.join(facts, "sid").select("block", "band", "sid", "label", "n", "sig", "bits")
        left = member.join(meet.withColumnRenamed("x", "block").withColumn("x", F.col("block")), "block").withColumn("side", F.when(F.col("x") == F.col("y"), -1).otherwise(0))
        right = member.join(meet.where("x <> y").withColumnRenamed("y", "block").withColumn("y", F.col("block")), "block").withColumn("side", F.lit(1))
        columns = ["x", "y", "side", "band", "sid", "label", "n", "sig", "bits"]
        met = left.select(columns).unionByName(right.select(columns)).repartition("x", "y").sortWithinPartitions("x", "y", "label", "sid")
        return stored(met.mapInArrow(_cross(s, spanning), PAIRS).groupBy("a", "b").agg(F.min("g").alias("g")), f"pairs_{name}")

    # then, of buckets that hold several labels, the best candidates that would connect them; a quarter of the bands will do
    labels = near_labels(edges, "star")
    labelled = blocks.select("band", "key", "sid").join(labels, "sid", "left").select("band", "key", "sid", F.coalesce("label", "sid").alias("label"))
    open_ = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    entries = labelled.join(open_, "key", "left_semi").repartitionByRange("key", "label", "sid").sortWithinPartitions("key", "label", "sid")
    parts = stored(entries.mapInArrow(_blocks(s.block), "key long, band int, sid binary, label binary, block long, lead binary"), "parts").select("key", "band", "sid", "block")
    if parts.isEmpty():
        return profile, sets, edges
    bridges = confirmed(candidates(parts.where(F.col("band") < s.hashes // s.rows // 4), labels, True, "best"), "edges_best")
    # last, all candidates between labels, in all bands
    grown = bridges.unionByName(labels.where("sid <> label").select(F.col("sid").alias("a"), F.col("label").alias("b")))
    rest = candidates(parts, near_labels(grown, "best"), False, "rest")
    edges = edges.unionByName(bridges).unionByName(confirmed(rest, "edges_rest"))
    return profile, sets, edges


def join(df: DataFrame, id_: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; kept are the rows whose id names the component."""
    profile, sets, edges = links(df, id_, text, settings)
    member = stored(components(edges).select(F.col("node").alias("sid"), "component"), "member")
    placed = sets.select("sid", "doc_id").join(member, "sid")
    lowest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    grouped = placed.join(lowest, "component").select("sid", "component_id")
    alone = sets.join(member, "sid", "left_anti").select("sid", F.col("doc_id").alias("component_id"))
    named = stored(grouped.unionByName(alone), "named")
    full = profile.where("n > 0").select("doc_id", "n", "sid").join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = profile.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
