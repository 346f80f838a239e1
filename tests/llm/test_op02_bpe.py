import random

import numpy as np
import pytest

from promptspread.llm import bpe
from promptspread.llm.queries.op2 import vocabulary_path
from tests.llm.helpers import docs, odd_texts

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


def stored_texts(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_encode_and_decode_equal_the_library(reference):
    rng = random.Random(1)
    parts = list("abcstmdlrve'''    \n\t  12 .,!-_é½²ñ中文  😀A<|") + ["<|endoftext|>", "'ll", "'re", "'ve", " the", "\r\n", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["x" * 700 + "the" * 300, "", " "]
    vocabulary = bpe.Vocabulary(vocabulary_path())
    words = [w.encode() for w in ("the", " the", " and", "'s", "ing", " thing", "éa", ".", "\n")]
    codec = bpe.Codec(vocabulary, bpe.Lexicon.compile(dict(zip(words, vocabulary.merge(words)))))
    ids, ends = codec.encode(*stored_texts(texts))
    expected = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == expected
    assert codec.decode(ids, ends) == [reference.decode(e, skip_special_tokens=False) for e in expected]


def test_lexicon_maps_its_words_and_no_others():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["a", "ab", "abc", "b", "bc", "tion", "nation", "station", "é"])}
    lexicon = bpe.Lexicon.map(bpe.Lexicon.compile(words))
    asked = [*words, b"abcd", b"", b"stat", b"c"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    size = np.array([len(w) for w in asked])
    found = lexicon.find(data, np.cumsum(size) - size, size)
    assert [lexicon.out[lexicon.out_start[n]:lexicon.out_start[n + 1]].tolist() if n >= 0 else None for n in found] == [*words.values(), None, None, None, None]
    assert len(lexicon.final) - 1 < sum(len(w) for w in words)  # endings are shared


def test_long_text_in_pieces(reference, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 1000)
    text = "word's  and\n\nmore " * 400
    codec = bpe.Codec(bpe.Vocabulary(vocabulary_path()), bpe.Lexicon.compile({}))
    data = np.frombuffer(text.encode(), np.uint8)
    parts = list(bpe.pieces(data, 1000))
    assert len(parts) > 3 and b"".join(p.tobytes() for p in parts) == text.encode()
    ids = np.concatenate([codec.encode(p, np.array([0, len(p)]))[0] for p in parts])
    assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark, reference):
    df = docs(spark, odd_texts())
    codec = bpe.build(df, vocabulary_path(), size=16)
    rows = bpe.encode(df, codec, decoded="back").collect()
    assert len(rows) == len(odd_texts())
    for r in rows:
        assert list(r.ids) == reference.encode(r.text or "", add_special_tokens=False).ids and r.back == (r.text or "")
    again = bpe.decode(bpe.encode(df, codec), codec).collect()
    assert sorted((r.decoded for r in again)) == sorted(t or "" for _, t in odd_texts())
    assert bpe.encode(df.limit(0), bpe.build(df.limit(0), vocabulary_path())).count() == 0
