"""Operator 8, exact n-gram Jaccard join with set-relation skipping.

Texts become sets of word-shingle hashes; texts with equal sets are one set.  Two
sets can only reach the threshold if their prefixes - their rarest elements in a
global order, one more than may be missing - share an element.

* Index skipping: an element's list is sorted by set size; size and position
  bounds skip most of its pairs.  A long list is cut into blocks, and pairs of
  blocks whose sizes can't match are never formed, so it becomes many small
  groups.  Parity bitmaps skip most other pairs: the bits in which two bitmaps
  differ are a lower bound of the elements in which the sets differ.
* Answer skipping: of a long list's group, a first round verifies a spanning
  forest of the closest pairs only.  Sets found connected have their answer; the
  second round skips all pairs inside a component and verifies every remaining
  pair.  When verifying, a set's overlaps with its partners follow from those of
  a highly similar set verified before, corrected by the elements in which the
  two differ.

No link is lost: components equal those of all pairs at the threshold.  No bound
on lists, partners or candidates exists.

Defined results: null texts and texts without a word have the empty set, size 0,
and are linked with nothing; a text with fewer words than a shingle has one
shingle.  Ids may repeat or be null: a null id never names a component, and a
component without any id is null.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptspread.llm import shingles
from promptspread.llm.common import SIMILARITY_PERCENT, slices, stored, utf8
from promptspread.llm.components import components

BLOCK = 1024           # entries of a long list's block
SHORT = 64             # lists up to this length name their pairs at once; longer ones are dealt in blocks first
COMMON_LIMIT = 1 << 19  # at most so many common elements are ordered by frequency; a fixed bound of what is broadcast
PROFILE = "doc_id long, h long, n long, sid binary, bitmap binary, element long, count long"
PAIRS = "a binary, b binary"


def set_id(s: np.ndarray) -> bytes:
    """128 bits of a set: two sums of differently mixed elements."""
    with np.errstate(over="ignore"):
        x, y = shingles.mix(s).sum(dtype=np.uint64), shingles.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return np.array([x, y], np.uint64).tobytes()


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the elements per bit; two to four bits per element, a power of two and at least 64."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    count = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(b: bytes, size: int) -> int:
    """A bitmap of fewer bytes: its parts' exclusive or, as a number."""
    x = int.from_bytes(b, "little")
    have = len(b)
    while have > size:
        have //= 2
        x = (x >> (8 * have)) ^ (x & ((1 << (8 * have)) - 1))
    return x


def needed(n1, n2):
    """Smallest overlap at which two sets of these sizes reach the threshold."""
    return -(-SIMILARITY_PERCENT * (n1 + n2) // (100 + SIMILARITY_PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-SIMILARITY_PERCENT * n // 100) + 1


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, identity and bitmap of every text's set; then the elements this task saw more than once."""
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("sid", pa.binary()), ("bitmap", pa.binary()),
                        ("element", pa.int64()), ("count", pa.int64())])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate([v for v, _ in seen]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([c for _, c in seen])).astype(np.int64)

    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingles.sets(*utf8(batch.column("text")))
            n = len(sets)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()), none, none], schema=schema)
            if n:
                seen.append(np.unique(np.concatenate(sets), return_counts=True))
            if sum(len(v) for v, _ in seen) > 4_000_000:  # drop what is rare so far: an order by estimated frequency is as right as any
                values, counts = merged()
                seen = [(values[counts > 1], counts[counts > 1])]
    if seen:
        values, counts = merged()
        values, counts = values[counts > 1], counts[counts > 1]
        empty = [pa.nulls(len(values), f.type) for f in schema][:5]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(values.view(np.int64)), pa.array(counts)], schema=schema)


def _prefixes(common: np.ndarray, rank: np.ndarray):
    """Prefix elements of every set: (token, sid, n, pos); a task sends a set that it meets again only once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole, "text"):
                tokens, sids, sizes = [], [], []
                for s in shingles.sets(*utf8(batch.column("text"))):
                    if not len(s) or (sid := set_id(s)) in met:
                        continue
                    met.add(sid)
                    at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
                    order = np.lexsort((s, np.where(common[at] == s, rank[at], 0))) if len(common) else np.arange(len(s))
                    tokens.append(s[order[:prefix_length(len(s))]])
                    sids.append(sid)
                    sizes.append(len(s))
                count = [len(t) for t in tokens]
                flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
                pos = np.concatenate([np.arange(c) for c in count]) if tokens else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array((flat >> np.uint64(32)).astype(np.uint32).view(np.int32)),  # equal halves only add candidates
                    pa.array(sids, pa.binary()).take(pa.array(np.repeat(np.arange(len(sids)), count))) if sids else pa.array([], pa.binary()),
                    pa.array(np.repeat(np.array(sizes, np.int32), count)), pa.array(pos.astype(np.int32))], names=["token", "sid", "n", "pos"])

    return run


def _blocks(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of blocks of a list sorted by size that can hold a match; the others are skipped whole."""
    low, high = sizes[::BLOCK], np.append(sizes[BLOCK - 1::BLOCK], sizes[-1:])[:len(sizes[::BLOCK])]
    return [(i, j) for i in range(len(low)) for j in range(i, len(low)) if SIMILARITY_PERCENT * int(low[j]) <= 100 * int(high[i])]


def _near_pairs(begin: np.ndarray, count: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within lists (runs of rows sorted by size) that the size and position bounds admit."""
    last = np.repeat(begin + count, count)
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    found, apart = [(np.zeros(0, np.int64),) * 2], 1
    while len(at):
        inside = at + apart < last
        at, last = at[inside], last[inside]
        fits = SIMILARITY_PERCENT * n[at + apart] <= 100 * n[at]  # sizes ascend: once too large, always too large
        at, last = at[fits], last[fits]
        other = at + apart
        good = np.minimum(n[at] - pos[at], n[other] - pos[other]) >= needed(n[at], n[other])
        found.append((at[good], other[good]))
        apart += 1
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of rows sorted by (token, n, sid), copies dropped: the pairs of short lists (group -1, ``other`` names
    the second set), and the entries of long lists, once for each pair of blocks they are part of."""
    rest = None
    names = ["token", "group", "side", "sid", "n", "pos", "other"]

    def finished(table: pa.Table) -> pa.RecordBatch:
        token, n, pos = (table.column(c).to_numpy() for c in ("token", "n", "pos"))
        sid = table.column("sid").combine_chunks()
        both = np.frombuffer(sid.buffers()[2], np.uint64).reshape(-1, 2)[sid.offset:sid.offset + len(sid)] if len(sid) else np.zeros((0, 2), np.uint64)
        again = np.zeros(len(token), bool)
        again[1:] = (token[1:] == token[:-1]) & (both[1:] == both[:-1]).all(axis=1)
        at = np.flatnonzero(~again)
        t, size = token[at], n[at].astype(np.int64)
        near = (t[1:] == t[:-1]) & (SIMILARITY_PERCENT * size[1:] <= 100 * size[:-1])
        keep = np.append(near, False) | np.append(False, near)
        at, t, size = at[keep], t[keep], size[keep]
        begin = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(t)))
        short = count <= SHORT
        x, y = _near_pairs(begin[short], count[short], size, pos[at].astype(np.int64))
        if len(x):
            ends = np.concatenate([both[at[x]], both[at[y]]], axis=1)
            flip = (ends[:, 0] > ends[:, 2]) | ((ends[:, 0] == ends[:, 2]) & (ends[:, 1] > ends[:, 3]))
            ends[flip] = ends[flip][:, [2, 3, 0, 1]]
            _, first = np.unique(np.ascontiguousarray(ends).view(np.dtype((np.void, 32))).ravel(), return_index=True)
            x, y = np.where(flip, y, x)[first], np.where(flip, x, y)[first]
        picked, group, side = [at[x]], [np.full(len(x), -1)], [np.zeros(len(x), np.int8)]
        others = at[y]
        for b, c in zip(begin[~short], count[~short]):
            for g, (i, j) in enumerate(_blocks(size[b:b + c])):
                for s, block in ((0, i), (1, j))[:1 + (i != j)]:
                    rows = at[b + block * BLOCK:min(b + (block + 1) * BLOCK, b + c)]
                    picked.append(rows)
                    # the side tells apart the blocks of a pair; -1 marks a block paired with itself
                    group.append(np.full(len(rows), g))
                    side.append(np.full(len(rows), -1 if i == j else s, np.int8))
        rows = np.concatenate(picked)
        other = pa.concat_arrays([sid.take(pa.array(others)), pa.nulls(len(rows) - len(others), pa.binary())])
        return pa.RecordBatch.from_arrays([pa.array(token[rows]), pa.array(np.concatenate(group)), pa.array(np.concatenate(side)),
                                           sid.take(pa.array(rows)), pa.array(n[rows]), pa.array(pos[rows]), other], names=names)

    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        token = table.column("token").to_numpy()
        if len(token):
            cut = int(np.searchsorted(token, token[-1]))  # the last list may go on in the next batch
            rest = table.slice(cut)
            if cut:
                yield finished(table.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield finished(rest)


def candidates(sizes: np.ndarray, positions: np.ndarray, bitmaps: list[bytes], sides: np.ndarray, labels: list[bytes | None] | None) -> list[tuple[int, int, int]]:
    """(difference, i, j) of the pairs of a group, sorted by size, that no bound excludes and that aren't connected yet."""
    out = []
    m = len(sizes)
    tail = sizes - positions
    if m <= 12:
        for i in range(m):
            for j in range(i + 1, m):
                if (sides[i] == sides[j] >= 0 and sides[i] + sides.max() > 0) or (labels is not None and labels[i] is not None and labels[i] == labels[j]):
                    continue
                least = needed(int(sizes[i]), int(sizes[j]))
                if SIMILARITY_PERCENT * sizes[j] > 100 * sizes[i] or min(tail[i], tail[j]) < least:
                    continue
                width = min(len(bitmaps[i]), len(bitmaps[j]))
                apart = (folded(bitmaps[i], width) ^ folded(bitmaps[j], width)).bit_count()
                if apart <= int(sizes[i] + sizes[j]) - 2 * least:
                    out.append((apart, i, j))
        return out
    width = np.array([len(b) for b in bitmaps])
    levels = {}
    two_sided = sides.max() > 0
    number: dict = {}
    label = None if labels is None else np.array([number.setdefault(x if x is not None else i, len(number)) for i, x in enumerate(labels)])
    for i in range(m - 1):
        stop = int(np.searchsorted(sizes, 100 * sizes[i] // SIMILARITY_PERCENT, side="right"))
        j = np.arange(i + 1, stop)
        if two_sided:
            j = j[sides[j] != sides[i]]
        if label is not None:
            j = j[label[j] != label[i]]
        least = needed(sizes[i], sizes[j])
        fits = np.minimum(tail[i], tail[j]) >= least
        j, least = j[fits], least[fits]
        if not len(j):
            continue
        w = int(width[i])
        if w not in levels:
            levels[w] = np.zeros((m, w // 8), np.uint64)
            for k in np.flatnonzero(width >= w):
                levels[w][k] = np.frombuffer(folded(bitmaps[k], w).to_bytes(w, "little"), np.uint64)
        apart = np.bitwise_count(levels[w][j] ^ levels[w][i]).sum(axis=1).astype(np.int64)
        good = apart <= sizes[i] + sizes[j] - 2 * least
        out += zip(apart[good].tolist(), [i] * int(good.sum()), j[good].tolist())
    return out


def forest(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The closest pairs that connect everything the pairs connect."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for _, i, j in sorted(pairs):
        a, b = top(i), top(j)
        if a != b:
            up[a] = b
            out.append((i, j))
    return out


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, bits_a, bits_b) with sizes n_a, n_b -> the pairs whose bitmaps don't exclude a match."""
    for batch in batches:
        a, b, x, y, n, m = (batch.column(c).to_pylist() for c in ("a", "b", "bits_a", "bits_b", "n_a", "n_b"))
        keep = []
        for p, q, size, other in zip(x, y, n, m):
            width = min(len(p), len(q))
            keep.append((folded(p, width) ^ folded(q, width)).bit_count() <= size + other - 2 * needed(size, other))
        yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(a, keep) if k], pa.binary()), pa.array([v for v, k in zip(b, keep) if k], pa.binary())], names=["a", "b"])


def _pairs(spanning: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        out: dict[tuple[bytes, bytes], None] = {}

        def close() -> None:
            if len(held) > 1:
                sids, n, pos, bits, sides, labels = zip(*held)
                found = candidates(np.array(n, np.int64), np.array(pos, np.int64), list(bits), np.array(sides, np.int64), list(labels))
                chosen = forest(found) if spanning else [(i, j) for _, i, j in found]
                out.update({(min(sids[i], sids[j]), max(sids[i], sids[j])): None for i, j in chosen})

        def flush() -> pa.RecordBatch:
            rows = list(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["a", "b"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("token", "group", "sid", "n", "pos", "bitmap", "side", "label"))
            for token, group, *row in zip(*columns):
                if (token, group) != key:
                    close()
                    held.clear()
                    key = token, group
                held.append(tuple(row))
            if len(out) > 200_000:
                yield flush()
        close()
        yield flush()

    return run


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if not len(x) or not len(y):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


class Answers:
    """Overlaps of one set with many; a set much like the one asked before is answered from its answer."""

    def __init__(self, target: np.ndarray):
        self.target, self.last, self.known = target, None, 0

    def overlap(self, s: np.ndarray) -> int:
        if self.last is not None:
            gone = s[np.minimum(np.searchsorted(s, self.last), len(s) - 1)] != self.last
            come = self.last[np.minimum(np.searchsorted(self.last, s), len(self.last) - 1)] != s
            if 4 * (gone.sum() + come.sum()) <= len(s):
                self.known += overlap(s[come], self.target) - overlap(self.last[gone], self.target)
                self.last = s
                return self.known
        self.last, self.known = s, overlap(s, self.target)
        return self.known


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by b: (a, b, text_a, text_b) -> the pairs that reach the threshold."""
    now, answers, size = None, None, 0
    for whole in batches:
        for batch in slices(whole, "text_a"):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left = shingles.sets(*utf8(batch.column("text_a")))
            good = []
            for i, s in enumerate(left):
                if b[i] != now:
                    now = b[i]
                    target = shingles.sets(*utf8(batch.column("text_b").slice(i, 1)))[0]
                    answers, size = Answers(target), len(target)
                common = answers.overlap(s)
                good.append(100 * common >= SIMILARITY_PERCENT * (len(s) + size - common))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, g in zip(a, good) if g], pa.binary()), pa.array([x for x, g in zip(b, good) if g], pa.binary())], names=["a", "b"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sids = [set_id(s) for s in shingles.sets(*utf8(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), batch.column("text")], names=["sid", "text"])


def links(df: DataFrame, id_: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(profile, edges): every row's set, and the verified edges (a, b) between sets that give the components of all links."""
    docs = df.select(F.col(f"`{id_}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    hashed = docs.withColumn("h", F.xxhash64("text"))
    scanned = stored(hashed.mapInArrow(_profile, PROFILE), "profile")
    profile = scanned.where("element IS NULL").select("doc_id", "h", "n", "sid", "bitmap")
    often = scanned.where("element IS NOT NULL").groupBy("element").agg(F.sum("count").alias("c")).where("c > 2")
    # the most common elements, whole frequency bins (16 to a doubling) from the top while they fit the bound
    bin_ = F.floor(F.log2("c") * 16).cast("int")
    floor, room = None, COMMON_LIMIT
    for r in often.groupBy(bin_.alias("bin")).count().orderBy(F.desc("bin")).collect():  # at most 16 * 63 rows
        if r["count"] > room:
            break
        floor, room = r.bin, room - r["count"]
    rows = often.where(F.lit(False) if floor is None else bin_ >= floor).toPandas()
    common = rows["element"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    tokens = docs.select("text").mapInArrow(_prefixes(common[order], rows["c"].to_numpy(np.int64)[order]), "token int, sid binary, n int, pos int")
    listed = stored(tokens.repartition("token").sortWithinPartitions("token", "n", "sid").mapInArrow(
        _lists, "token int, group long, side byte, sid binary, n int, pos int, other binary"), "lists")
    sets = profile.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.min(F.struct("doc_id", "h")).alias("at"))
    end = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"bits_{c}"))
    named = listed.where("group = -1").select(F.col("sid").alias("a"), F.col("other").alias("b")).distinct()
    short = stored(named.join(end("a"), "a").join(end("b"), "b").mapInArrow(_close_pairs, PAIRS), "short_pairs")
    long = listed.where("group >= 0").drop("other")
    asked = short.select(F.col("a").alias("sid")).unionByName(short.select(F.col("b").alias("sid"))).unionByName(long.select("sid")).distinct()
    # whole texts travel once, and only the asked ones any further; the same way at every size
    where = sets.join(asked, "sid", "left_semi").select(_key(F.col("at.doc_id")).alias("key"), F.col("at.h").alias("h"))
    keyed = hashed.select(_key(F.col("doc_id")).alias("key"), "h", "text")
    texts = keyed.join(where.hint("merge"), ["key", "h"], "left_semi").dropDuplicates(["key", "h"])
    texts = stored(texts.select("text").mapInArrow(_named, "sid binary, text string"), "texts")

    def verified(found: DataFrame, round_: int) -> DataFrame:
        left, right = texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))
        both = found.distinct().join(left, "a").join(right, "b").sortWithinPartitions("b", "a").select("a", "b", "text_a", "text_b")
        return stored(both.mapInArrow(_verify, PAIRS), f"edges_of_round_{round_}")

    def of_long_lists(labels: DataFrame | None) -> DataFrame:
        rows = long.join(sets.select("sid", "bitmap"), "sid")
        rows = rows.withColumn("label", F.lit(None).cast("binary")) if labels is None else rows.join(labels, "sid", "left")
        return rows.repartition("token", "group").sortWithinPartitions("token", "group", "n", "sid").mapInArrow(_pairs(labels is None), PAIRS)

    first = verified(short.unionByName(of_long_lists(None)), 1)
    labels = stored(components(first).select(F.col("node").alias("sid"), F.col("component").alias("label")), "labels")
    return profile, first.unionByName(verified(of_long_lists(labels), 2))


def _key(id_: Column) -> Column:
    return F.coalesce(id_.cast("string"), F.lit("null"))


def join(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, n_shingles, component_id, keeper) for every row; h is a hash of its text.

    ``keeper`` marks the component's first row by (doc_id with null last, h), and
    every row with the empty set.
    """
    profile, edges = links(df, id_, text)
    member = components(edges).select(F.col("node").alias("sid"), "component")
    placed = profile.where("n > 0").join(member, "sid", "left").withColumn("c", F.coalesce("component", "sid"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    named = placed.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min(place).alias("lead"))
    size = F.col("n").alias("n_shingles")
    full = placed.join(named, "c").select("doc_id", "h", size, "component_id", (place == F.col("lead")).alias("keeper"))
    empty = profile.where("n = 0").select("doc_id", "h", size, F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper"))
    return full.unionByName(empty)
