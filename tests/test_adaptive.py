"""Running state over few hot keys, seeded Beta draws, perturbed copies."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from promptspread.functions.ranking import running_sums
from promptspread.operators import bandit as B
from promptspread.operators import prompts as P
from promptspread.operators import scoring as SC


def test_running_sums_with_one_key_holding_most_rows(spark):
    rng = random.Random(2)
    rows = [("hot", i, rng.randrange(10), 0.5) for i in range(3000)] + [("x", i * 700, 1, 1.5) for i in range(9)] + [("y", 5, 7, 0.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, a long, b double")
    got = {(r.k, r.i): (r.sa, round(r.sb, 9)) for r in running_sums(df, ["k"], "i", {"sa": "a", "sb": "b"}, block=64).collect()}
    want, total = {}, Counter()
    for k, i, a, b in sorted(rows):
        total[k, "a"] += a
        total[k, "b"] += b
        want[k, i] = (total[k, "a"], round(total[k, "b"], 9))
    assert got == want
    plan = running_sums(df, ["k"], "i", {"sa": "a"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "__block" in plan


def test_calibration_follows_the_evaluation_order(spark):
    rng = random.Random(4)
    rows = [(i, 0, c, 0, 1, rng.random()) for i in range(50) for c in range(2)]
    df = spark.createDataFrame(rows, "instance_id long, format_id int, class int, pos_from_end int, answer_length int, logprob double")
    order = {r.instance_id: r.ord for r in SC.evaluation_order(df, 9).collect()}
    assert sorted(order.values()) == list(range(50)) and order != {i: i for i in range(50)}
    got = {(r.instance_id, r["class"]): r.score for r in SC.batch_calibrated_scores(df, SC.evaluation_order(df, 9), 8).collect()}
    for c in range(2):
        means = []
        for batch in range(7):
            inside = [(i, x) for i, _, k, _, _, x in rows if k == c and order[i] // 8 == batch]
            means.append(np.mean([x for _, x in inside]))
            for i, x in inside:
                assert abs(got[i, c] - (x - np.mean(means))) < 1e-12


def test_beta_draws_follow_their_distribution_and_their_key(spark):
    # for whole a, b the distribution function of Beta(a, b) is a binomial tail
    def below(x, a, b):
        n = a + b - 1
        return sum(math.comb(n, j) * x ** j * (1 - x) ** (n - j) for j in range(a, n + 1))

    for a, b in ((2, 5), (40, 9), (300, 700)):
        df = spark.range(1500).select(B.beta_draw(F.lit(float(a)), F.lit(float(b)), B.draw_key(7, 1, 0, F.col("id"))).alias("x"))
        first = [r.x for r in df.collect()]
        assert first == [r.x for r in df.collect()] and len(set(first)) == 1500 and all(0 < x < 1 for x in first)
        order = sorted(below(x, a, b) for x in first)
        distance = max(max(abs(u - i / 1500), abs(u - (i + 1) / 1500)) for i, u in enumerate(order))
        assert distance < 1.95 / math.sqrt(1500)   # Kolmogorov and Smirnov at 0.1 %
    small = spark.range(1500).select(B.gamma_draw(F.lit(1.1), F.col("id").cast("string")).alias("x")).agg(F.avg("x"), F.variance("x")).first()
    assert abs(small[0] - 1.1) < 0.1 and abs(small[1] - 1.1) < 0.25


def test_perturbed_copies_replace_an_exact_number(spark):
    words = ["@a", "@b", "@c"]
    texts = ["w " * 99 + "w", "one two", "", None, " ".join(f"t{i}" for i in range(20_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = P.with_perturbed(df, "text", ["id"], 3, 0.1, words).collect()
    assert len(rows) == 15 and {r.copy_id for r in rows} == {1, 2, 3}
    for r in rows:
        old, new = (r.text or "").split(" "), r.perturbed.split(" ")
        assert r.n_tokens == len(old) == len(new) and r.n_replaced == len(old) // 10 == sum(w in words for w in new)
        assert all(a == b or b in words for a, b in zip(old, new))
    big = [r.perturbed for r in rows if r.id == 4]
    assert len(set(big)) == 3
    for part in range(4):   # replaced places and new tokens are spread evenly
        assert abs(sum(w in words for w in big[0].split(" ")[part * 5000:(part + 1) * 5000]) - 500) < 120
    assert all(abs(big[0].split(" ").count(w) - 667) < 120 for w in words)
    vocabulary = P.vocabulary(spark.createDataFrame([("a b b",), ("c a",), (None,)], "text string"), "text", 2)
    assert len(vocabulary) == 2 and set(vocabulary) < {"a", "b", "c"}


def plain_beta(a, b, key):
    def uniform(k, tag):
        return (int(hashlib.md5(f"{k}|{tag}".encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48

    def gamma(shape, k):
        d = shape - 1 / 3
        for i in range(64):
            x = math.sqrt(-2 * math.log(uniform(k, f"r{i}"))) * math.cos(2 * math.pi * uniform(k, f"t{i}"))
            v = (1 + x / math.sqrt(9 * d)) ** 3
            if v > 0 and math.log(uniform(k, f"u{i}")) < 0.5 * x * x + d - d * v + d * math.log(v):
                return d * v

    x, y = gamma(a, key + "|a"), gamma(b, key + "|b")
    return x / (x + y)


def plain_search(batches, default, steps, seed):
    """The two phases as a loop."""
    n = {a: sum(x for x, _ in bs) if a == default else 0 for a, bs in batches.items()}
    s = {a: sum(x for _, x in bs) if a == default else 0 for a, bs in batches.items()}
    k, n_max = dict.fromkeys(batches, 0), {a: sum(x for x, _ in bs) for a, bs in batches.items()}
    p = min(s[default] / n[default], 1 - 1e-9)
    a0, b0 = max(p / (1 - p) * 5, 1.1), 5
    history = []

    def final(highest):
        return (max if highest else min)((s[a] / n[a], f"arm_{a:02d}", a) for a in batches if n[a])[2]

    for phase in (1, 2):
        for step in range(steps):
            draws = {a: plain_beta(a0 + s[a], b0 + n[a] - s[a], f"{seed}|{phase}|{step}|{a}") for a in batches if n[a] < n_max[a]}
            if not draws:
                break
            pick = max(draws, key=lambda a: (draws[a], -a)) if phase == 1 else min(draws, key=lambda a: (draws[a], a))
            bn, bs = batches[pick][k[pick]]
            n[pick], s[pick], k[pick] = n[pick] + bn, s[pick] + bs, k[pick] + 1
            history.append((phase, step, pick, final(phase == 1)))
    last = lambda phase: [h[3] for h in history if h[0] == phase][-1:]
    return history, (last(1) or [final(True)])[0], (last(2) or [final(False)])[0]


def test_two_phase_search_against_a_plain_loop(spark):
    rng = random.Random(8)
    batches = {a: [(20, sum(rng.random() < 0.3 + a / 20 for _ in range(20))) for _ in range(3 + a % 3)] + [(7, 3)] for a in range(8)}
    for chosen, steps in ((batches, 6), (batches, 30), ({a: batches[a] for a in (0, 1)}, 4), ({0: batches[0]}, 2)):
        bc = spark.createDataFrame([(a, i, n, s) for a, bs in chosen.items() for i, (n, s) in enumerate(bs)], "arm long, batch_no long, n long, s long")
        (r,) = B.two_phase_search(bc, 0, steps, 42).collect()
        history, best, worst = plain_search(chosen, 0, steps, 42)
        assert [tuple(h) for h in r.history] == history and (r.best_arm, r.worst_arm) == (best, worst)


def test_two_phase_search_with_untried_arms_under_ansi(spark):
    batches = {a: [(20, 4 + a), (20, 9 + a), (5, a)] for a in range(5)}
    bc = spark.createDataFrame([(a, i, n, s) for a, bs in batches.items() for i, (n, s) in enumerate(bs)], "arm long, batch_no long, n long, s long")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")   # Spark's default: dividing by the rows of an untried arm raised
    try:
        (r,) = B.two_phase_search(bc, 0, 3, 42).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    history, best, worst = plain_search(batches, 0, 3, 42)
    assert [tuple(h) for h in r.history] == history and (r.best_arm, r.worst_arm) == (best, worst)
