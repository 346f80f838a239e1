import random

import numpy as np

from promptspread.llm import lang_id
from promptspread.llm.queries import QUERIES
from tests.conftest import SF_ORACLE
from tests.llm.helpers import docs, odd_texts


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op1_language_id"](spark, SF_ORACLE).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 150
    assert sum(truth[r.doc_id] == r.lang_pred for r in unseen) >= 0.97 * len(unseen)


def test_odd_rows_and_clashing_columns(spark):
    learn = docs(spark, [(i, "the cat and the dog " * 3) for i in range(20)], "en").unionByName(docs(spark, [(i, "der Hund und die Katze " * 3) for i in range(20)], "de"))
    model = lang_id.train(learn)
    df = docs(spark, odd_texts() + [(9, "die Katze und der Hund")])
    rows = lang_id.predict(df, model).collect()
    assert len(rows) == len(odd_texts()) + 1 and set(rows[0].asDict()) == {*df.columns, "lang_pred"}
    by = [(r.doc_id, r.text, r.lang_pred, r.score) for r in rows]
    assert all(p == "und" and s == 0 for _, t, p, s in by if t is None or not any(c.isalpha() for c in t))
    assert all(p in ("en", "de") for _, t, p, s in by if t and any(c.isalpha() for c in t))
    assert ("de" in {p for i, _, p, _ in by if i == 9})
    assert len({(p, s) for i, _, p, s in by if i == 4}) == 1


def test_no_labels_and_empty_table(spark):
    df = docs(spark, [(1, "some text")], lang=None)
    assert lang_id.train(df) is None
    assert [(r.lang_pred, r.score) for r in lang_id.identify(df, df.doc_id.isNotNull()).collect()] == [("und", 0.0)]
    assert lang_id.identify(df.limit(0), df.doc_id.isNotNull()).count() == 0


def test_language_that_is_mostly_copies(spark):
    few = [(i, f"der Hund und die Katze {i}") for i in range(10)]
    copies = spark.range(40_000).selectExpr("id AS doc_id", "'die Katze schläft heute' AS text", "'de' AS lang")
    df = docs(spark, [(i, f"the cat and the dog {i}") for i in range(10)], "en").unionByName(docs(spark, few, "de")).select("doc_id", "text", "lang").unionByName(copies)
    model = lang_id.train(df, settings=lang_id.Settings(per_lang=4, epochs=1))
    assert model is not None and model.languages == ("de", "en")


def plain(model, text):
    """Windows, filters, pooling and the softmax layer in loops over whole numbers."""
    s = model.settings
    total = np.zeros(len(model.languages))
    for lo in range(0, max(1, len(text)), s.window):
        window = list(text[lo:lo + s.window])
        tokens = window + [lang_id.PAD] * (s.window + max(s.widths) - 1 - len(window))
        flat = [[int(v) for v in model.embedding[t]] for t in tokens]
        responses = []
        for f in range(model.kernel.shape[1]):
            weights = [int(v) for v in model.kernel[:, f]]
            responses.append(max(sum(w * v for w, v in zip(weights, sum(flat[p:p + max(s.widths)], []))) for p in range(s.window)) + int(model.bias[f]))
        z = [sum(max(r, 0) * int(o) for r, o in zip(responses, column)) * model.unit for column in model.out.T] + model.out_bias
        total += (z - z.max() - np.log(np.exp(z - z.max()).sum())) * len(window)
    return total / max(1, len(text))


def test_network_against_plain_loops_and_any_batch():
    rng = random.Random(2)
    small = lang_id.Settings(window=24, dim=3, widths=(2, 4), filters=3, per_lang=8, epochs=2, block=5)
    learn = [" ".join(rng.choice(["the", "cat", "dog"]) for _ in range(9)).encode() for _ in range(8)], [" ".join(rng.choice(["der", "Hund", "é"]) for _ in range(9)).encode() for _ in range(8)]
    model = lang_id.fit(learn[0] + learn[1], ["en"] * 8 + ["de"] * 8, small)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5, 23, 24, 25, 100, 300)] + learn[0]
    ends = np.cumsum([0, *map(len, texts)])
    together = lang_id.log_probabilities(model, np.frombuffer(b"".join(texts), np.uint8), ends)
    for i, t in enumerate(texts):
        alone = lang_id.log_probabilities(model, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert (alone == together[i]).all() and np.abs(alone - plain(model, t)).max() < 1e-12


def test_sums_of_the_full_network_are_exact():
    rng = np.random.default_rng(3)
    s = lang_id.Settings()
    k = s.filters * len(s.widths)
    model = lang_id.quantised(("a", "b"), rng.normal(size=(257, s.dim)), rng.normal(size=(max(s.widths) * s.dim, k)), rng.normal(size=k), rng.normal(size=(k, 2)), np.zeros(2), s)
    assert 127 * np.abs(model.kernel).sum(axis=0).max() + np.abs(model.bias).max() < 2 ** 24
    assert 2 ** 24 * np.abs(model.out).sum(axis=0).max() <= 2 ** 53
    assert all((p == np.rint(p)).all() for p in (model.embedding, model.kernel, model.bias, model.out))


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    dim, widest, k, n = 3, 4, 5, 6
    mask = np.ones((widest * dim, k))
    params = [rng.normal(size=(257, dim)), rng.normal(size=(widest * dim, k)), rng.normal(size=k), rng.normal(size=(k, 3)), rng.normal(size=3)]
    params[0][lang_id.PAD] = 0
    x, y = rng.integers(0, 256, (n, 12)), rng.integers(0, 3, n)

    def loss():
        emb, kernel, bias, out, out_bias = params
        cols = lang_id._positions(x, emb, widest)
        h = np.maximum((cols @ kernel).max(axis=1) + bias, 0)
        return -np.log(lang_id._softmax(h @ out + out_bias)[np.arange(n), y]).mean()

    for p, g in zip(params, lang_id.gradients(x, y, params, mask)):
        for at in np.argsort(-np.abs(g).ravel())[:20]:
            held, step = p.flat[at], 1e-6
            p.flat[at] = held + step
            up = loss()
            p.flat[at] = held - step
            down = loss()
            p.flat[at] = held
            assert abs((up - down) / (2 * step) - g.flat[at]) < 1e-6
