import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from promptspread.llm import bbit_minhash, shingles
from promptspread.llm.common import utf8
from tests.llm.helpers import against_oracle, connected, docs, odd_texts, shingle_set

S = bbit_minhash.Settings()


def brute(rows):
    sets = [shingle_set(t, 2) for _, t in rows]
    edges = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    top = connected(range(len(rows)), edges)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top[j] == top[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((str(k), len(sets[i]), str(least), k == least))
    return sorted(out)


def got(df, settings=S):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in bbit_minhash.join(df, settings=settings).collect())


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


def corpus(rng):
    word = lambda: f"v{rng.randrange(3000)}"
    texts = []
    for size, n, edits in ((60, 90, 6), (150, 100, 14), (7, 12, 2), (300, 10, 20)):
        texts += family(rng, [word() for _ in range(size)], n, edits)
    chain = [word() for _ in range(80)]
    for i in range(60):  # each near the next only
        chain[i % 80] = word()
        texts.append(" ".join(chain))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def test_oracle(spark):
    against_oracle(spark, "op11_bbit_minhash")


@pytest.mark.parametrize("block", [1024, 8])
def test_brute_force_with_families_chains_and_odd_rows(spark, block):
    rows = corpus(random.Random(4)) + odd_texts() + [(900, "a b"), (901, "A B"), (902, "a c"), (903, "a"), (904, "A")]
    assert got(docs(spark, rows), bbit_minhash.Settings(block=block)) == brute(rows)


def test_a_group_of_copies_and_near_copies_with_a_third_of_all_rows(spark):
    rng = random.Random(6)
    base = [f"v{rng.randrange(500)}" for _ in range(40)]
    rows = [(i, " ".join(base)) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(family(rng, base, 150, 3))]
    rows += [(5000 + i, " ".join(f"u{rng.randrange(10 ** 5)}" for _ in range(20))) for i in range(600)]
    assert got(docs(spark, rows), bbit_minhash.Settings(block=16)) == brute(rows)


def pair(rng, size, share):
    """Two sets of shingle hashes whose Jaccard similarity is ``share``."""
    common = int(round(size * share))
    pool = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    cut = (size - common) // 2
    return pool[:common + cut], np.concatenate([pool[:common], pool[common + cut:]])


def test_estimate_and_bands_behave_as_theory_says():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8, 0.9):
        agree, met = [], 0
        for _ in range(400):
            a, b = pair(rng, int(rng.choice([20, 100, 400])), share)
            low = bbit_minhash.minima(np.concatenate([a, b]), np.array([0, len(a)]), S)
            x, y = bbit_minhash.signatures(low, S)
            agree.append(int(bbit_minhash.agreeing(x, y, S)))
            k, m = bbit_minhash.band_keys(np.stack([x, y]), S)
            met += bool((k == m).any())
        estimate = bbit_minhash.similarity(np.array(agree))
        assert abs(estimate.mean() - share) < 0.012
        p = 1 / 256 + 255 / 256 * share
        assert 0.8 < estimate.std() / (np.sqrt(p * (1 - p) / 128) * 256 / 255) < 1.25
        if share >= 0.8:
            assert met == 400 and min(agree) >= bbit_minhash.least_agreeing(S)
    assert 70 <= bbit_minhash.least_agreeing(S) <= 90


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_bit_counts_equal_a_comparison_place_by_place(bits):
    s = bbit_minhash.Settings(bits=bits)
    low = np.random.default_rng(bits).integers(0, 40, (6, s.hashes)).astype(np.uint32)
    spread = shingles.mix(low.astype(np.uint64) + np.arange(s.hashes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(2 ** bits - 1)
    packed = bbit_minhash.signatures(low, s)
    for i, j in itertools.product(range(6), repeat=2):
        assert int(bbit_minhash.agreeing(packed[i], packed[j], s)) == int((spread[i] == spread[j]).sum())


def test_minima_are_those_of_each_text_alone():
    texts = ["a b c d", "x", "a b c d e " * 9000, "b c"]
    data, offsets = utf8(pa.array(texts))
    h, row = shingles.shingles(data, offsets, 2)
    begin = np.searchsorted(row, np.arange(4))
    whole = bbit_minhash.minima(h, begin, S)
    for i in range(4):
        assert (whole[i] == bbit_minhash.minima(h[row == i], np.array([0]), S)[0]).all()


def test_blocks_keep_every_shared_key(spark):
    rng = np.random.default_rng(8)
    rows = sorted({(int(k), int(v).to_bytes(16, "big")) for k, v in zip(rng.integers(0, 60, 900), rng.integers(0, 1 << 40, 900))} | {(7, bytes([i] * 16)) for i in range(90)})
    df = spark.createDataFrame([(0, *r) for r in rows], "band int, key long, sid binary").repartitionByRange(5, "key", "sid").sortWithinPartitions("key", "sid")
    out = df.mapInArrow(bbit_minhash._blocks(8), "band int, key long, sid binary, block long, lead binary").collect()
    for k in {r[0] for r in rows}:
        mine = {r[1] for r in rows if r[0] == k}
        seen = [r for r in out if r.key == k]
        assert len(seen) == len({r.sid for r in seen}) and (len(mine) == 1 or {bytes(r.sid) for r in seen} == mine)
    for b in {r.block for r in out}:
        part = [r for r in out if r.block == b]
        assert len(part) <= 8 and len({r.key for r in part}) == 1 and {bytes(r.lead) for r in part} == {min(bytes(r.sid) for r in part)}


def test_cross_pairs_and_forest():
    group = np.array([0, 0, 0, 0, 1, 1, 2])
    side = np.array([-1, -1, -1, -1, 0, 1, 0])
    label = np.array([0, 1, 1, 2, 0, 3, 1])
    n = np.array([100, 100, 100, 100, 100, 100, 100])
    sig, bits = np.zeros((7, 16), np.uint64), [bytes(8)] * 7
    first = np.zeros(7, np.int64)
    i, j, agree = bbit_minhash.cross_pairs(group, side, first, label, n, sig, bits, S)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (0, 3), (1, 3), (2, 3), (4, 5)] and set(agree) == {128}
    assert not len(bbit_minhash.cross_pairs(group, side, first + 3, label, n, sig, bits, S)[0])  # named in their first band only
    node = np.array([0, 1, 1, 2, 3, 4, 5])
    picked = bbit_minhash.forest(i, j, agree, node)
    assert len(picked) == 3  # three labels of the first group need two pairs, the second group one


def test_empty(spark):
    assert got(docs(spark, [])) == [] and got(docs(spark, [(1, None), (2, "")])) == [("1", 0, "1", True), ("2", 0, "2", True)]


def test_bitmaps_never_overstate_the_difference():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 700):
        for share in (0.1, 0.7, 0.85, 1.0):
            a, b = (np.unique(x) for x in pair(rng, size, share))
            differ = len(np.setxor1d(a, b))
            assert bbit_minhash.apart(bbit_minhash.bitmap(a), bbit_minhash.bitmap(b)) <= differ
            common = len(np.intersect1d(a, b))
            assert (100 * common >= 80 * (len(a) + len(b) - common)) == (differ <= bbit_minhash.may_differ(len(a), len(b), S))
