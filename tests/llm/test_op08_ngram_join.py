import itertools
import random

from promptspread.llm import ngram_join
from tests.llm.helpers import against_oracle, connected, docs, odd_texts, shingle_set


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    edges = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    top = connected(range(len(rows)), edges)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top[j] == top[i] and rows[j][0] is not None]
        out.append((str(k), len(sets[i]), str(min(ids) if ids else None)))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.join(df).collect())


def family(rng, base, n, edits):
    """Copies with words replaced; neighbours are more alike than the ends."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


def test_oracle(spark):
    against_oracle(spark, "op8_ngram_jaccard")


def test_brute_force_with_families_and_a_common_passage(spark):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(3000)}"
    texts = []
    for size, n, edits in ((60, 90, 5), (150, 100, 8), (7, 12, 2), (300, 10, 12)):
        texts += family(rng, [word() for _ in range(size)], n, edits)
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += odd_texts()[:-2] + [(900, "a b c d"), (901, "A b c D"), (902, "a b c e")]
    assert got(docs(spark, rows)) == brute(rows)


def test_lists_short_and_long_give_the_same_pairs(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    rows = []
    for token in range(40):
        for sid in rng.choice(60, rng.integers(1, 30), replace=False):
            rows.append((token, sid.astype(np.int64).tobytes() * 2, int(20 + sid), int(rng.integers(0, 4))))
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    rows = [r for r in rows for _ in range(1 + r[2] % 2)]  # copies
    schema = pa.schema([("token", pa.int32()), ("sid", pa.binary()), ("n", pa.int32()), ("pos", pa.int32())])
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def pairs(short, block):
        monkeypatch.setattr(ngram_join, "SHORT", short)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        out, groups = set(), {}
        for batch in ngram_join._lists(iter(table.to_batches(max_chunksize=37))):
            for r in batch.to_pylist():
                if r["group"] == -1:
                    out.add(frozenset((r["sid"], r["other"])))
                else:
                    groups.setdefault((r["token"], r["group"]), []).append(r)
        for g in groups.values():
            for x, y in itertools.combinations(sorted(g, key=lambda r: (r["n"], r["sid"])), 2):
                if x["side"] == y["side"] >= 0:
                    continue
                if 80 * y["n"] <= 100 * x["n"] and min(x["n"] - x["pos"], y["n"] - y["pos"]) >= ngram_join.needed(x["n"], y["n"]):
                    out.add(frozenset((x["sid"], y["sid"])))
        return out

    whole = pairs(100, 8)
    assert len(whole) > 100 and pairs(5, 4) == whole == pairs(0, 3)


def test_blocks_cover_all_pairs_that_fit(monkeypatch):
    import numpy as np

    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    sizes = np.sort(np.random.default_rng(0).integers(5, 80, 50))
    pairs = set(ngram_join._blocks(sizes))
    for i, j in itertools.combinations(range(50), 2):
        if 80 * sizes[j] <= 100 * sizes[i]:
            assert (i // 4, j // 4) in pairs


def test_candidates_small_and_large_groups_agree():
    import numpy as np

    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 80).astype(np.uint64))
    sets = []
    for _ in range(30):
        s = base.copy()
        s[rng.integers(0, len(s), rng.integers(0, 14))] = rng.integers(0, 1 << 63, 1).astype(np.uint64)
        sets.append(np.unique(s))
    sets.sort(key=len)
    n, pos = np.array([len(s) for s in sets]), rng.integers(0, 4, 30)
    bits, side, label = [ngram_join.bitmap(s) for s in sets], np.zeros(30, int), [None] * 30
    large = {(i, j) for _, i, j in ngram_join.candidates(n, pos, bits, side, label)}
    for i, j in itertools.combinations(range(30), 2):
        pick = [i, j]
        small = ngram_join.candidates(n[pick], pos[pick], [bits[i], bits[j]], side[pick], [None, None])
        assert bool(small) == ((i, j) in large)
        common = ngram_join.overlap(sets[i], sets[j])
        if 100 * common >= 80 * (n[i] + n[j] - common) and min(n[i] - pos[i], n[j] - pos[j]) >= ngram_join.needed(int(n[i]), int(n[j])):
            assert (i, j) in large  # no link is lost


def test_answers_follow_from_a_similar_set():
    import numpy as np

    rng = np.random.default_rng(2)
    target = np.unique(rng.integers(0, 500, 200).astype(np.uint64))
    answers, s = ngram_join.Answers(target), np.unique(rng.integers(0, 500, 200).astype(np.uint64))
    for _ in range(40):
        assert answers.overlap(s) == len(np.intersect1d(s, target))
        s = np.unique(np.concatenate([s[rng.random(len(s)) > 0.05], rng.integers(0, 500, 8).astype(np.uint64)]))


def test_empty(spark):
    assert got(docs(spark, [])) == [] and got(docs(spark, [(1, None), (2, "")])) == [("1", 0, "1"), ("2", 0, "2")]
