import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from promptspread.llm import periodic
from promptspread.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import against_oracle, docs, odd_texts


def brute(t, least=6, k=4):
    """Every period of every stretch, by comparing words q apart."""
    out = {}
    for q in range(1, len(t) // k + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j - i >= (k - 1) * q and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items() if n >= least)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def squeezed(ws, runs):
    return " ".join(w for i, w in enumerate(ws) if not any(a + q <= i < a + n for a, n, q in runs))


def test_oracle(spark):
    against_oracle(spark, "op13_periodic_runs")


def test_random_sequences_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 12)):
            n, kinds = rng.randrange(0, 200), rng.choice([1, 2, 3, 5, 50])
            t = [rng.randrange(kinds) for _ in range(n)]
            for _ in range(rng.randrange(4) if n > 8 else 0):
                at, p, length = rng.randrange(n), rng.randrange(1, max(2, n // 5)), rng.randrange(1, n)
                for i in range(at + p, min(n, at + length)):
                    t[i] = t[i - p]
            texts.append(np.array(t, np.int64))
        assert periodic.find(texts) == [brute(t.tolist()) for t in texts]


def test_nested_and_overlapping_runs_against_brute_force():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 700:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    inner = ([1, 2] * 6 + [3]) * 7                       # runs of period 2 inside a run of period 13
    deep = ((([5] * 4 + [6]) * 5 + [7]) * 4 + [8]) * 4   # three levels
    touching = [1, 1, 2] * 5 + [1, 2] * 9 + [2] * 9
    texts = [np.array(t, np.int64) for t in (fibonacci[-1], inner, deep, touching, [9] * 1000, [9] * 3, [], [1, 2, 3] * 4, [1, 2, 3] * 3 + [1, 2])]
    found = periodic.find(texts)
    assert found == [brute(t.tolist()) for t in texts]
    assert (0, 91, 13) in found[1] and found[4] == [(0, 1000, 1)] and found[7] == [(0, 12, 3)] and found[8] == []


def test_synchronising_places_depend_on_their_context_alone():
    rng = np.random.default_rng(2)
    for scale in (1, 4, 16):
        block = rng.integers(0, 9, 6 * scale)
        seq = np.concatenate([rng.integers(0, 9, 50), block, rng.integers(0, 9, 33), block, rng.integers(0, 9, 50)])
        hashes = np.array([hash(tuple(seq[i:i + scale])) & 0x7FFFFFFFFFFFFFFF for i in range(len(seq))], np.uint64)
        chosen = set(periodic.synchronising(hashes, scale, np.zeros(len(seq), bool)).tolist())
        first, second = 50, 50 + len(block) + 33
        inside = range(len(block) - 2 * scale + 1)
        assert [first + i in chosen for i in inside] == [second + i in chosen for i in inside]
        assert all(any(p + i in chosen for i in range(scale)) for p in range(len(seq) - 4 * scale))


def test_rewritten_documents_against_plain_python(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    seen = 0
    for r in QUERIES["op13_periodic_runs"](spark, SF_SMALL).collect():
        ws = words(texts[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(ws)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        runs = brute(ws)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(squeezed(ws, runs).encode()).hexdigest()
        seen += bool(runs)
    assert seen > 5


def test_odd_rows_ties_and_clashing_columns(spark):
    own = [(20, "x y " * 5), (20, "x y " * 5), (21, "a a a a a a b b b b b b"), (22, "é é é é é é"), (23, "A a A a A a A a"), (None, "z " * 7), (24, "a a a a a b"),
           (25, "lorem ipsum dolor " * 30_000)]
    df = docs(spark, odd_texts() + own).withColumnRenamed("score", "Runs").withColumnRenamed("Ids", "body")
    rows = periodic.detect(df).collect()
    assert len(rows) == len(odd_texts()) + len(own) and rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "body", "runs", "strongest", "collapsed"}
    for r in rows:
        if r.doc_id in (7, 25):
            continue
        ws = words(r.text)
        runs = brute(ws)
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == squeezed(ws, runs) and r.body == "clash"
        assert (r.strongest is None) == (not runs)
    by = {r.doc_id: r for r in rows}
    assert tuple(by[21].strongest) == (0, 6, 1)  # a tie goes to the smaller start
    assert tuple(by[25].strongest) == (0, 90_000, 3) and by[25].collapsed == "lorem ipsum dolor"
    assert by[24].runs == [] and by[23].strongest.period == 2


def test_empty_table(spark):
    assert periodic.detect(docs(spark, [])).collect() == []
