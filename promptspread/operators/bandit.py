"""Adaptive format search (E17-E23): cumulative accuracy, intervals, Thompson / UCB, two-phase loop.

The outcome log (arm, ord, batch_no, ok) is the model's verdict per evaluated
row.  Per-arm state is a tiny aggregate; every score and choice is a Column
expression or an aggregate over it, and the two-phase search (E23) a fold.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptspread.functions.ranking import running_sums

# Fixed values (must equal the reference): the prior's failure pseudo-count, the
# floor on its success pseudo-count, and the exhausted-arm mask.
PRIOR_B = 5.0
PRIOR_A_MIN = 1.1
EXHAUSTED = 1e9


def batch_counts(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Per (arm, batch): rows and successes (integer counts)."""
    return outcomes.groupBy(*keys, "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("s"))


def cumulative_accuracy(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Running totals over evaluation batches, block by block: an arm may hold any share of the rows."""
    b = running_sums(batch_counts(outcomes, keys), keys, "batch_no", {"cum_total": "n", "cum_successes": "s"})
    return b.select(*keys, "batch_no", "cum_total", "cum_successes").withColumn("cum_accuracy", F.col("cum_successes") / F.col("cum_total"))


def prior(default_acc: Column) -> tuple[Column, Column]:
    """E19 prior: b0 = 5, a0 = max(acc/(1-acc)*b0, 1.1); acc is clamped below 1 (the reference divides by 0)."""
    acc = F.least(default_acc, F.lit(1 - 1e-9))
    return F.greatest(acc / (1 - acc) * PRIOR_B, F.lit(PRIOR_A_MIN)), F.lit(PRIOR_B)


ATTEMPTS = 64   # of the gamma sampler; each fails with probability below 0.05, so all of them with 1e-83


def _uniform(key: Column, tag: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the key and tag alone."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", key, tag)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def gamma_draw(shape: Column, key: Column) -> Column:
    """A Gamma(shape, 1) draw for shape >= 1 by acceptance and rejection, a function of the key alone.

    An attempt takes a normal x and a uniform u, and v = (1 + cx) ** 3 with
    d = shape - 1/3, c = 1 / sqrt(9d); it gives dv if ln u < x*x/2 + d - dv + d ln v.
    """
    d = shape - 1.0 / 3
    c = 1 / F.sqrt(9 * d)

    def attempt(i: Column) -> Column:
        tag = lambda letter: F.concat(F.lit(letter), i.cast("string"))
        x = F.sqrt(-2 * F.ln(_uniform(key, tag("r")))) * F.cos(2 * pi * _uniform(key, tag("t")))
        one = F.struct(x.alias("x"), (1 + c * x).alias("w"), F.ln(_uniform(key, tag("u"))).alias("lu"))
        return F.transform(F.array(one), lambda a: F.transform(F.array(F.struct(a["x"].alias("x"), F.when(a["w"] > 0, a["w"] * a["w"] * a["w"]).alias("v"), a["lu"].alias("lu"))),
                                                               lambda q: F.when(q["lu"] < 0.5 * q["x"] * q["x"] + d - d * q["v"] + d * F.ln(q["v"]), d * q["v"]))[0])[0]

    return F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(None).cast("double"), lambda found, i: F.when(found.isNotNull(), found).otherwise(attempt(i)))


def beta_draw(a: Column, b: Column, key: Column) -> Column:
    """A Beta(a, b) draw for a, b >= 1, a function of the key (seed, arm, step) alone."""
    parts = F.struct(gamma_draw(a, F.concat(key, F.lit("|a"))).alias("x"), gamma_draw(b, F.concat(key, F.lit("|b"))).alias("y"))
    return F.transform(F.array(parts), lambda p: p["x"] / (p["x"] + p["y"]))[0]


def draw_key(seed: int, phase: int, step: int, arm: Column) -> Column:
    return F.concat_ws("|", F.lit(f"{seed}|{phase}|{step}"), arm.cast("string"))


def ucb_score(s: Column, n: Column, t: Column) -> Column:
    """s/n + 2*sqrt(ln(1+t)/n); both terms 0 when the arm was never evaluated."""
    ratio = F.when(n > 0, s / n).otherwise(F.lit(0.0))
    bonus = F.when(n > 0, 2 * F.sqrt(F.log(1 + t) / n)).otherwise(F.lit(0.0))
    return ratio + bonus


def masked(score: Column, n: Column, n_max: Column, objective: str) -> Column:
    """Exhausted arms get +1e9 (lowest) / -1e9 (highest) so they are never chosen."""
    return F.when(n >= n_max, F.lit(EXHAUSTED if objective == "lowest" else -EXHAUSTED)).otherwise(score)


def choose(state: DataFrame, score: str, objective: str, arm: str = "arm") -> DataFrame:
    """The next arm = argmax/argmin of the masked score; empty when every arm is exhausted."""
    live = state.where(F.abs(F.col(score)) < EXHAUSTED)
    order = F.col(score).desc() if objective == "highest" else F.col(score).asc()
    return live.orderBy(order, F.col(arm)).limit(1)


def final_arm(state: DataFrame, objective: str, label: str = "label") -> DataFrame:
    """Best (highest) / worst (lowest) accuracy among tried arms; ties by label in the same direction."""
    tried = state.where(F.col("n") > 0).withColumn("acc", F.col("s") / F.col("n"))
    if objective == "highest":
        return tried.orderBy(F.col("acc").desc(), F.col(label).desc()).limit(1)
    return tried.orderBy(F.col("acc").asc(), F.col(label).asc()).limit(1)


def two_phase_search(bc: DataFrame, default_arm: int, steps: int, seed: int) -> DataFrame:
    """``steps`` Thompson steps for the best arm, then as many for the worst with the state carried over.

    One row: ``history`` (phase, step, chosen_arm, final_arm), ``best_arm``, ``worst_arm``.  ``bc`` is the
    per-(arm, batch) count table.  A search never uses more than the first ``2 * steps`` batches of an arm, so
    what meets in one row follows from the number of arms and steps, however many outcomes there are; the steps
    themselves are a fold over it, each draw a function of (seed, phase, step, arm).  The default arm is fully
    evaluated from the start; a phase ends when all arms are.  Without a step in the second phase the worst arm
    is that of the state the first one left.
    """
    used = F.when(F.col("batch_no") < 2 * steps, F.struct("batch_no", "n", "s"))
    arms = bc.groupBy("arm").agg(F.sum("n").alias("n_max"), F.sum("s").alias("s_all"), F.sort_array(F.collect_list(used)).alias("batches"))
    row = arms.agg(F.sort_array(F.collect_list(F.struct("arm", F.format_string("arm_%02d", "arm").alias("label"), "n_max", "s_all", "batches"))).alias("arms"))
    default = F.filter("arms", lambda a: a["arm"] == default_arm)[0]
    a0, b0 = prior(default["s_all"] / default["n_max"])
    row = row.select("arms", a0.alias("a0"), b0.alias("b0"))
    is_default = lambda a: a["arm"] == default_arm
    event = "struct<phase: int, step: int, chosen_arm: bigint, final_arm: bigint>"
    start = F.struct(F.transform("arms", lambda a: F.when(is_default(a), a["n_max"]).otherwise(0)).alias("n"),
                     F.transform("arms", lambda a: F.when(is_default(a), a["s_all"]).otherwise(0)).alias("s"),
                     F.transform("arms", lambda a: F.lit(0)).alias("k"), F.array().cast(f"array<{event}>").alias("history"))

    def tried(s: Column) -> Column:
        return F.filter(F.transform("arms", lambda a, i: F.struct(F.try_divide(F.get(s["s"], i), F.get(s["n"], i)).alias("acc"), a["label"].alias("label"), a["arm"].alias("arm"))), lambda t: t["acc"].isNotNull())

    def winner(s: Column, highest: Column) -> Column:
        return F.when(highest, F.array_max(tried(s))["arm"]).otherwise(F.array_min(tried(s))["arm"])

    def step(s: Column, t: Column) -> Column:
        first = t < steps
        phase, number = F.when(first, 1).otherwise(2), F.when(first, t).otherwise(t - steps)

        def score(a: Column, i: Column) -> Column:
            key = F.concat_ws("|", F.lit(str(seed)), phase.cast("string"), number.cast("string"), a["arm"].cast("string"))
            draw = beta_draw(F.col("a0") + F.get(s["s"], i), F.col("b0") + F.get(s["n"], i) - F.get(s["s"], i), key)
            return F.struct(F.when(F.get(s["n"], i) < a["n_max"], F.when(first, draw).otherwise(-draw)).alias("score"), (-i).alias("at"))

        live = F.filter(F.transform("arms", score), lambda x: x["score"].isNotNull())
        pick = -F.array_max(live)["at"]   # ties go to the smaller arm
        return F.transform(F.array(pick), lambda p: F.when(p.isNull(), s).otherwise(_evaluate(s, p, phase, number, first)))[0]

    def _evaluate(s: Column, p: Column, phase: Column, number: Column, first: Column) -> Column:
        batch = F.get(F.get(F.col("arms"), p)["batches"], F.get(s["k"], p))
        more = lambda values, plus: F.transform(values, lambda v, i: F.when(i == p, v + plus).otherwise(v))
        now = F.struct(more(s["n"], batch["n"]).alias("n"), more(s["s"], batch["s"]).alias("s"), more(s["k"], F.lit(1)).alias("k"), s["history"].alias("history"))
        return F.transform(F.array(now), lambda q: F.struct(q["n"].alias("n"), q["s"].alias("s"), q["k"].alias("k"), F.concat(q["history"], F.array(F.struct(
            phase.alias("phase"), number.alias("step"), F.get(F.col("arms"), p)["arm"].alias("chosen_arm"), winner(q, first).alias("final_arm")).cast(event))).alias("history")))[0]

    def found(s: Column) -> Column:
        last = lambda phase: F.try_element_at(F.filter(s["history"], lambda h: h["phase"] == phase), F.lit(-1))["final_arm"]
        return F.struct(s["history"].alias("history"), F.coalesce(last(1), winner(s, F.lit(True))).alias("best_arm"), F.coalesce(last(2), winner(s, F.lit(False))).alias("worst_arm"))

    result = F.aggregate(F.sequence(F.lit(0), F.lit(2 * steps - 1)), start, step, found)
    return row.select(result.alias("r")).select("r.*")
