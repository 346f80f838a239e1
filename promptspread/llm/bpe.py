"""Operator 2, byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus' frequent words are counted by Spark, encoded once, and compiled on
the driver into a minimal acyclic automaton (words share suffixes as well as
prefixes).  Walking a word adds up, over its transitions, how many words sort
before it; that number indexes the table of id outputs, so the automaton is a
transducer word -> ids.  Its arrays form one file that every worker maps into
memory.  A slice of texts is cut into words with array operations, its distinct
words walk the automaton together, and words outside the lexicon are merged
exactly by rank, so the result never depends on what the lexicon holds.

Bounds: the lexicon takes at most ``size`` words of at most ``longest`` bytes;
texts are processed in pieces of about four megabytes, cut only between a
visible character and a blank, where the pre-tokenizer always cuts too.

Defined results: a null or empty text has no ids and decodes to the empty
string.  Control strings of the vocabulary inside a text become their own id,
as in the library of the vocabulary file.  Repeated rows encode alike, extra
columns pass through, and input columns that clash with an output are replaced.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import tempfile
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptspread.llm.common import slices, stored, unused, utf8

LETTER, NUMBER, OTHER, BLANK = range(4)
PIECE = 4_000_000  # bytes handled at a time

# Letters and numbers of Unicode 16 that the 15.1 tables of this Python lack.
UNICODE_16 = (
    (0x1C89, 0x1C8A, LETTER), (0xA7CB, 0xA7CD, LETTER), (0xA7DA, 0xA7DC, LETTER), (0x105C0, 0x105F3, LETTER),
    (0x10D40, 0x10D49, NUMBER), (0x10D4A, 0x10D65, LETTER), (0x10D6F, 0x10D85, LETTER), (0x10EC2, 0x10EC4, LETTER),
    (0x11380, 0x11389, LETTER), (0x1138B, 0x1138B, LETTER), (0x1138E, 0x1138E, LETTER), (0x11390, 0x113B5, LETTER),
    (0x113B7, 0x113B7, LETTER), (0x113D1, 0x113D1, LETTER), (0x113D3, 0x113D3, LETTER), (0x116D0, 0x116E3, NUMBER),
    (0x11BC0, 0x11BE0, LETTER), (0x11BF0, 0x11BF9, NUMBER), (0x13460, 0x143FA, LETTER), (0x16100, 0x1611D, LETTER),
    (0x16130, 0x16139, NUMBER), (0x16D40, 0x16D6C, LETTER), (0x16D70, 0x16D79, NUMBER), (0x18CFF, 0x18CFF, LETTER),
    (0x1CCF0, 0x1CCF9, NUMBER), (0x1E5D0, 0x1E5ED, LETTER), (0x1E5F0, 0x1E5F0, LETTER), (0x1E5F1, 0x1E5FA, NUMBER),
)


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER, "Z": BLANK}
    for i in range(sys.maxunicode + 1):
        kind = kinds.get(unicodedata.category(chr(i))[0])
        if kind is not None:
            table[i] = kind
    table[[9, 10, 11, 12, 13, 0x85]] = BLANK
    for low, high, kind in UNICODE_16:
        table[low:high + 1] = kind
    return table


def byte_characters() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others take code points from 256 on, in byte order."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


class Vocabulary:
    """Ids, bytes and merge ranks of a byte-level BPE file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_characters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.tokens[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for content, i in self.special.items():
            self.tokens[i] = content
        self.byte_id = [vocab[c] for c, _ in sorted(to_byte.items(), key=lambda kv: kv[1])]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])

        by_key = sorted((a * len(self.tokens) + b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.pair_keys, self.pair_ranks, self.pair_ids = (np.array(c, np.int64) for c in zip(*by_key)) if by_key else (np.zeros(0, np.int64),) * 3

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Position of each pair of ids in the rank tables; the pairs that never merge get the closing entry."""
        key = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
        return np.where(self.pair_keys[at] == key, at, -1) if len(self.pair_keys) else np.full(len(key), -1)

    def merge_all(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words stored one after another: (ids, number of ids of each word).

        All words take one merge a round: each word's pair of lowest rank, the
        leftmost of equal ones.  Words beyond 48 bytes are merged one by one.
        """
        size = np.diff(bounds)
        short = np.flatnonzero((size > 0) & (size <= 48))
        ids = np.array(self.byte_id, np.int64)[gather(data, bounds[short], size[short])]
        word, never = np.repeat(short, size[short]), np.int64(1) << 62
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = self._ranks(ids[:-1], ids[1:])
        pair[word[:-1] != word[1:]] = -1
        pair = np.append(pair, -1)
        while len(ids):
            n = len(ids)
            rank = np.where(pair >= 0, self.pair_ranks[pair] * n + np.arange(n), never)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, begins)
            live = best < never
            if not live.all():
                over = np.repeat(~live, np.diff(np.append(begins, n)))
                done.append((word[over], ids[over]))
                word, ids, pair = word[~over], ids[~over], pair[~over]
                continue
            at = best % n
            ids[at] = self.pair_ids[pair[at]]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol has gone from each word before
            word, ids, pair = word[keep], ids[keep], pair[keep]
            for i in (at[at > 0] - 1, at[at < len(ids) - 1]):
                fresh = self._ranks(ids[i], ids[i + 1])
                pair[i] = np.where(word[i] == word[i + 1], fresh, -1)
            pair[-1:] = -1
        counts = np.zeros(len(size), np.int64)
        for w in np.flatnonzero(size > 48):
            long = np.array(self._merge_long([self.byte_id[b] for b in data[bounds[w]:bounds[w + 1]]]), np.int64)
            done.append((np.full(len(long), w), long))
        words = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        flat = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        np.add.at(counts, words, 1)
        return flat[np.argsort(words, kind="stable")].astype(np.int32), counts

    def merge(self, words: list[bytes]) -> list[list[int]]:
        ids, counts = self.merge_all(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """One long word in n log n: candidate pairs in a heap, live neighbours in two link arrays."""
        n, merges = len(ids), self.merges
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := merges.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (m := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``values[start:start + size]``, one after another."""
    before = np.cumsum(size) - size
    return values[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def word_offsets(data: np.ndarray, offsets: np.ndarray, special: re.Pattern | None) -> np.ndarray:
    """Byte offsets at which words start in texts stored one after another, with the total length at the end.

    Words: contractions; a run of letters, numbers or other visible characters with
    one blank before it; the remaining white space, whose last character stands
    alone where a visible character follows.
    """
    if not len(data):
        return np.zeros(1, np.int64)
    raw = data.tobytes()
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte offset of each character
    n = len(points)
    first = np.zeros(n + 1, bool)  # a text, or a part of it between control strings, starts here
    first[np.searchsorted(at, offsets)] = True
    controls = [m.span() for m in special.finditer(raw)] if special is not None else []
    spans = np.searchsorted(at, np.array(controls, np.int64).reshape(-1, 2))
    same_text = [np.searchsorted(offsets, x, side="right") == np.searchsorted(offsets, y - 1, side="right") for x, y in controls]
    inside = [span for span, same in zip(spans, same_text) if same]
    for a, b in inside:
        first[a] = first[b] = True

    kind = character_classes()[points]
    blank = kind == BLANK
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last blank before a visible character starts a word; if it is a space, that character joins it
    joins = blank[:-1] & ~blank[1:] & ~first[1:n]
    start[:-1] |= joins
    start[1:] &= ~(joins & (points[:-1] == 32))
    # contractions, where a word starts with the apostrophe
    q = np.flatnonzero((points == 39) & start)
    if len(q):
        padded = np.append(points, [0, 0])
        one, two = padded[q + 1], padded[q + 2]
        same1 = ~first[np.minimum(q + 1, n)]
        same2 = same1 & ~first[np.minimum(q + 2, n)]
        short = same1 & np.isin(one, [ord(c) for c in "stmd"])
        pair = same2 & (((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l"))))
        for hit, size in ((q[short], 2), (q[pair], 3)):
            start[hit + 1] = False
            start[np.minimum(hit + size, n - 1)[hit + size < n]] = True
    for a, b in inside:
        start[a + 1:b] = False
    return np.append(at[start], len(data))


class Lexicon:
    """A minimal acyclic automaton over words, with their ids, in one mapped file."""

    PARTS = (("keys", np.int64), ("target", np.int32), ("skip", np.int32), ("final", np.uint8), ("out_start", np.int64), ("out", np.int32))

    def __init__(self, parts: dict[str, np.ndarray]):
        self.__dict__.update(parts)

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> bytes:
        """Build from sorted words: states that accept the same endings become one as soon as they are complete."""
        ordered = sorted(w for w in words if w)
        register: dict[tuple, int] = {}
        done: list[tuple] = []  # complete states: (is final, ((byte, state), ...))
        path: list[list] = [[False, []]]  # open states along the last word: [is final, finished children]

        def close(down_to: int, word: bytes) -> None:
            while len(path) - 1 > down_to:
                final, children = path.pop()
                key = (final, tuple(children))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(done)
                    done.append(key)
                path[-1][1].append((word[len(path) - 1], state))

        last = b""
        for word in ordered:
            same = len(os.path.commonprefix([last, word]))
            close(same, last)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        close(0, last)
        root = len(done)
        done.append((path[0][0], tuple(path[0][1])))
        size = np.zeros(len(done), np.int64)  # words accepted from a state on; children come before parents
        keys, target, skip = [], [], []
        for state, (final, children) in enumerate(done):
            before = int(final)
            for byte, child in children:
                keys.append(state << 8 | byte)
                target.append(child)
                skip.append(before)
                before += int(size[child])
            size[state] = before
        outputs = [words[w] for w in ordered]
        parts = {
            "keys": keys, "target": target, "skip": skip, "final": [*(f for f, _ in done), 0],
            "out_start": np.concatenate([[0], np.cumsum([len(o) for o in outputs])]), "out": [i for o in outputs for i in o],
        }
        arrays = [np.asarray(parts[name], kind) for name, kind in Lexicon.PARTS]
        head = np.array([root, *(len(a) for a in arrays)], np.int64)
        return b"".join([head.tobytes(), *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)])

    @classmethod
    def map(cls, image: bytes) -> "Lexicon":
        """Map the automaton into memory from a file of its own; the file's name goes at once, so nothing is left behind."""
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            raw = np.memmap(f, np.uint8, "r")
        head = raw[:8 * (1 + len(cls.PARTS))].view(np.int64)
        parts, pos = {"root": int(head[0])}, head.nbytes
        for (name, kind), n in zip(cls.PARTS, head[1:]):
            size = int(n) * np.dtype(kind).itemsize
            parts[name] = raw[pos:pos + size].view(kind)
            pos += size + -size % 8
        return cls(parts)

    def find(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each word in the lexicon, -1 for words it does not hold; all words walk in step."""
        state, number = np.full(len(start), self.root, np.int64), np.zeros(len(start), np.int64)
        live = np.flatnonzero(size > 0) if len(self.keys) else np.zeros(0, np.int64)
        result = np.full(len(start), -1, np.int64)
        depth = 0
        while len(live):
            key = state[live] << 8 | data[start[live] + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[edge] == key
            live, edge = live[known], edge[known]
            state[live] = self.target[edge]
            number[live] += self.skip[edge]
            depth += 1
            ended = size[live] == depth
            over = live[ended]
            accepted = over[self.final[state[over]] == 1]
            result[accepted] = number[accepted]
            live = live[~ended]
        return result


class Codec:
    """Vocabulary plus compiled lexicon; travels to the workers, where the automaton is mapped on first use."""

    def __init__(self, vocabulary: Vocabulary, image: bytes):
        self.vocabulary, self.image = vocabulary, image
        self._ready = None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "image": self.image, "_ready": None}

    def _open(self):
        if self._ready is None:
            v = self.vocabulary
            size = np.array([len(t) for t in v.tokens], np.int64)
            pattern = re.compile(b"|".join(re.escape(s) for s in sorted(v.special, key=len, reverse=True))) if v.special else None
            self._ready = (Lexicon.map(self.image), pattern, np.frombuffer(b"".join(v.tokens), np.uint8), np.cumsum(size) - size, size)
        return self._ready

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts stored one after another, and the offsets of each text's ids."""
        lexicon, pattern, _, _, _ = self._open()
        cuts = word_offsets(data, offsets, pattern)
        words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        bounds = np.frombuffer(distinct.buffers()[1], np.int32)[:len(distinct) + 1].astype(np.int64)
        chars = np.frombuffer(distinct.buffers()[2], np.uint8) if len(distinct) else np.zeros(0, np.uint8)
        number = lexicon.find(chars, bounds[:-1], np.diff(bounds))
        start, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        known = number >= 0
        start[known] = lexicon.out_start[number[known]]
        size[known] = lexicon.out_start[number[known] + 1] - start[known]
        unseen = np.flatnonzero(~known)
        length = bounds[unseen + 1] - bounds[unseen]
        fresh, count = self.vocabulary.merge_all(gather(chars, bounds[unseen], length), np.concatenate([[0], np.cumsum(length)]))
        table = np.concatenate([lexicon.out, fresh])
        start[unseen] = len(lexicon.out) + np.cumsum(count) - count
        size[unseen] = count
        for content, i in self.vocabulary.special.items():
            if pattern.search(raw := chars.tobytes()) is None:
                break
            for w in unseen[length == len(content)]:
                if raw[bounds[w]:bounds[w + 1]] == content:
                    table, start[w], size[w] = np.append(table, np.int32(i)), len(table), 1
        index = coded.indices.to_numpy()
        ids = gather(table, start[index], size[index])
        ends = np.concatenate([[0], np.cumsum(size[index])])
        return ids, ends[np.searchsorted(cuts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Text of each run of ids; bytes that form no character become replacement characters."""
        _, _, chars, start, size = self._open()
        ends = np.concatenate([[0], np.cumsum(size[ids])])[offsets]
        raw = gather(chars, start[ids], size[ids]).tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def pieces(data: np.ndarray, budget: int = PIECE) -> Iterator[np.ndarray]:
    """Cut one long text after visible ASCII characters that a space follows, where no word continues."""
    start = 0
    while len(data) - start > budget:
        stop = None
        for lo in range(start + budget, len(data), budget):
            block = data[lo - 1:lo + budget]
            hit = np.flatnonzero((block[1:] == 32) & (block[:-1] > 32) & (block[:-1] < 127))
            if len(hit):
                stop = lo + int(hit[0])
                break
        if stop is None:
            break
        yield data[start:stop]
        start = stop
    yield data[start:]


def _valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with bytes that are not UTF-8 replaced; nothing changes for valid texts."""
    raw = data[offsets[0]:offsets[-1]].tobytes()
    try:
        raw.decode()
        return np.frombuffer(raw, np.uint8), offsets - offsets[0]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets, offsets[1:])]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _count_words(special: re.Pattern | None, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                data, offsets = _valid(*utf8(batch.column(0)))
                for chunk, local in _chunks(data, offsets):
                    cuts = word_offsets(chunk, local, special)
                    words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(chunk)])
                    counts = words.value_counts()
                    word, n = counts.field(0), counts.field(1)
                    fits = pa.array(np.diff(np.frombuffer(word.buffers()[1], np.int32)[:len(word) + 1]) <= longest) if len(word) else pa.array([], pa.bool_())
                    yield pa.RecordBatch.from_arrays([word.filter(fits), n.filter(fits)], names=["word", "n"])

    return run


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """A slice as it is, or a single long text in pieces."""
    if len(offsets) == 2 and len(data) > PIECE:
        return ((p, np.array([0, len(p)])) for p in pieces(data))
    return [(data, offsets)]


def frequent_words(df: DataFrame, vocabulary: Vocabulary, text: str = "text", size: int = 1 << 18, longest: int = 64) -> DataFrame:
    """(word): the most frequent words of all texts, counted per slice and summed by Spark; at most ``size`` (a fixed bound)."""
    special = re.compile(b"|".join(map(re.escape, vocabulary.special))) if vocabulary.special else None
    counts = df.select(F.col(f"`{text}`").alias("t")).mapInArrow(_count_words(special, longest), "word binary, n long")
    counts = stored(counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "word_counts")
    # words of about equal count share a bin (16 to a doubling); whole bins are taken from the top while they fit
    bin_ = F.floor(F.log2("n") * 16).cast("int")
    floor, room = None, size
    for r in counts.groupBy(bin_.alias("bin")).count().orderBy(F.desc("bin")).collect():  # at most 16 * 63 rows
        if r["count"] > room:
            break
        floor, room = r.bin, room - r["count"]
    return counts.where(F.lit(False) if floor is None else bin_ >= floor).select("word")


def build(df: DataFrame, path: str, text: str = "text", size: int = 1 << 18) -> Codec:
    """A codec for the vocabulary file at ``path`` whose lexicon holds the frequent words of ``df``.

    One task merges and compiles these words, at most ``size``; the driver holds the
    vocabulary and the finished image only.
    """
    vocabulary = Vocabulary(path)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        words = [w for batch in batches for w in batch.column(0).to_pylist() if w not in own.special]
        yield pa.RecordBatch.from_arrays([pa.array([Lexicon.compile(dict(zip(words, own.merge(words))))], pa.binary())], names=["image"])

    row = frequent_words(df, vocabulary, text, size).repartition(1).mapInArrow(compiled, "image binary").first()
    shared.unpersist()
    return Codec(vocabulary, Lexicon.compile({}) if row is None else bytes(row.image))


def encode(df: DataFrame, codec: Codec, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` plus the ids of each text and, if ``decoded`` names a column, the text decoded from those ids."""
    spark = df.sparkSession
    outputs = [ids] if decoded is None else [ids, decoded]
    clash = {o.lower() for o in outputs}
    body = unused([*df.columns, *outputs], "body")
    kept = [c for c in df.columns if c.lower() not in clash]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([] if decoded is None else [T.StructField(decoded, T.StringType())])
    schema = T.StructType([f for f in df.schema.fields if f.name.lower() not in clash] + added)
    shared = spark.sparkContext.broadcast(codec)  # the vocabulary and a lexicon of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in slices(whole, body, PIECE):
                data, offsets = _valid(*utf8(batch.column(body)))
                done = [own.encode(chunk, local) for chunk, local in _chunks(data, offsets)]
                found = np.concatenate([d[0] for d in done])
                ends = done[0][1] if len(done) == 1 else np.array([0, len(found)])
                values = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))]
                if decoded is not None:
                    values.append(pa.array(own.decode(found, ends), pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *values], names=[*kept, *outputs])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(body)).mapInArrow(run, schema)


def decode(df: DataFrame, codec: Codec, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` plus the text of an id column; null ids decode to the empty string."""
    kept = [c for c in df.columns if c.lower() != text.lower()]
    source = unused([*df.columns, text], "source")
    schema = T.StructType([f for f in df.schema.fields if f.name.lower() != text.lower()] + [T.StructField(text, T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(source)
            sizes = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64) if column.null_count else column.value_lengths().to_numpy().astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            out = shared.value.decode(values, np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], names=[*kept, text])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias(source)).mapInArrow(run, schema)
