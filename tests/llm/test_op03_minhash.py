import hashlib

import numpy as np

from promptspread.llm import minhash, shingles
from promptspread.llm.queries.op3 import fingerprint_edits
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs, odd_texts, shingle_set


def test_edits_and_likeness_against_brute_force(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = sorted(((r.doc_id, r.text) for r in table.select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint_edits(table).collect()}
    assert len(got) == len(texts)
    off = []
    for i, (k, text) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        assert got[k].n_chars == len(text) and got[k].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = shingle_set(text), shingle_set(changed), shingle_set(following)
        off += [got[k].near_edited - len(a & b) / len(a | b), got[k].near_next - len(a & c) / len(a | c)]
    assert np.abs(off).max() < 0.2 and np.abs(off).mean() < 0.03 and abs(np.mean(off)) < 0.01


def test_equal_bins_are_filled_and_unbiased():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.8):
        errors = []
        for _ in range(40):
            n = 60
            k = int(2 * n * share / (1 + share))
            a, common = [f"a{rng.integers(1 << 60)}" for _ in range(n - k)], [f"c{rng.integers(1 << 60)}" for _ in range(k)]
            b = [f"b{rng.integers(1 << 60)}" for _ in range(n - k)]
            # one word a shingle, so the sets are what we say
            raw = [" ".join(a + common).encode(), " ".join(b + common).encode()]
            s = minhash.Settings(words=1)
            x, y = minhash.sketch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, len(raw[0]), len(raw[1])]), s)
            errors.append(minhash.likeness(x, y, s) - k / (2 * n - k))
        assert abs(np.mean(errors)) < 0.03


def test_odd_rows(spark):
    df = docs(spark, odd_texts()).withColumnRenamed("Ids", "Fingerprint")
    rows = minhash.fingerprint(df).collect()
    assert len(rows) == len(odd_texts())
    prints = {}
    for r in rows:
        prints.setdefault(r.text, set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and prints[None] == prints[""] == {""}
    assert prints["Alpha beta gamma delta eps zeta"] == prints["alpha beta GAMMA delta eps zeta"]
    chained = fingerprint_edits(df).collect()
    assert len(chained) == len(odd_texts()) and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in chained)
    assert fingerprint_edits(df.limit(0)).count() == 0
    assert len(fingerprint_edits(df.where("doc_id = 5")).collect()) == 1


def test_shingle_sets_equal_word_tuples():
    texts = ["", "a", "a b c d e f", "A b C d e F", "x\ty\x0bz", " one  two\nthree four five six ", "é É 中 文 q w"]
    raw = [t.encode() for t in texts]
    sets = shingles.sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *(len(r) for r in raw)]))
    words = [shingle_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in words]
    assert all((set(sets[i].tolist()) == set(sets[j].tolist())) == (words[i] == words[j]) for i in range(len(texts)) for j in range(len(texts)))
