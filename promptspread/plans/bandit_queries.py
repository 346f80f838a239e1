"""Queries E17-E23 over the arm-outcome view (V7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptspread.operators import bandit as B
from promptspread.plans.registry import register
from promptspread.sources import views as V

BATCH = 20
T_STEP = 10           # time index of the UCB bonus
DEFAULT_ARM = 0
STEPS_PER_PHASE = 50   # half of the budget of model calls, in batches
SEED = 42


def _state(spark, d):
    """Arm state at the halfway point of the evaluation: every arm has seen the first half of its batches
    (at least one).  Built from per-(arm, batch) counts - small aggregated rows."""
    bc = B.batch_counts(V.arm_outcomes(spark, d), ["arm"])
    # one row per arm, and the arms are the formats of one search: always small
    half = F.broadcast(bc.groupBy("arm").agg(F.greatest(F.floor((F.max("batch_no") + 1) / 2), F.lit(1)).alias("half"), F.sum("n").alias("n_max")))
    seen = bc.join(half, "arm").where(F.col("batch_no") < F.col("half"))
    return seen.groupBy("arm", "n_max").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("batch_no").alias("last"))


STATE_SQL = f"""bc AS (SELECT arm, batch_no, count(*) AS n, sum(ok) AS s FROM arm_outcomes GROUP BY arm, batch_no),
bh AS (SELECT *, greatest(floor((max(batch_no) OVER (PARTITION BY arm) + 1) / 2), 1) AS half FROM bc),
st AS (SELECT arm, sum(n) AS n, sum(s) AS s, max(batch_no) AS last FROM bh WHERE batch_no < half GROUP BY arm),
tot AS (SELECT arm, sum(n) AS n_max FROM bc GROUP BY arm),
state AS (SELECT st.*, tot.n_max FROM st JOIN tot USING (arm))"""


@register("e17_cumulative_accuracy", views=("arm_outcomes",), sql="""
WITH b AS (SELECT arm, batch_no, count(*) AS n, sum(ok) AS s FROM arm_outcomes GROUP BY arm, batch_no)
SELECT arm, batch_no,
       CAST(sum(n) OVER (PARTITION BY arm ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_total,
       CAST(sum(s) OVER (PARTITION BY arm ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_successes,
       round(CAST(sum(s) OVER (PARTITION BY arm ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
             / sum(n) OVER (PARTITION BY arm ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum_accuracy
FROM b""")
def e17_cumulative_accuracy(spark, d):
    """Cumulative accuracy per arm over its evaluation batches (integer running sums)."""
    c = B.cumulative_accuracy(V.arm_outcomes(spark, d), ["arm"])
    return c.select("arm", "batch_no", F.col("cum_total").cast("bigint"), F.col("cum_successes").cast("bigint"), "cum_accuracy")


@register("e18_next_interval", views=("arm_outcomes",), sql=f"""
WITH {STATE_SQL},
nxt AS (SELECT arm, (last + 1) * {BATCH} AS lo, (last + 2) * {BATCH} AS hi FROM state)
SELECT nxt.arm, CAST(nxt.lo AS BIGINT) AS lo, CAST(nxt.hi AS BIGINT) AS hi,
       CAST(count(o.ord) AS BIGINT) AS n_rows, count(o.ord) = 0 AS exhausted
FROM nxt LEFT JOIN arm_outcomes o ON o.arm = nxt.arm AND o.ord >= nxt.lo AND o.ord < nxt.hi
GROUP BY nxt.arm, nxt.lo, nxt.hi""")
def e18_next_interval(spark, d):
    """The next unevaluated interval of each arm and the rows it holds; empty when exhausted."""
    st = _state(spark, d).select("arm", ((F.col("last") + 1) * BATCH).cast("bigint").alias("lo"),
                                 ((F.col("last") + 2) * BATCH).cast("bigint").alias("hi"))
    o = V.arm_outcomes(spark, d).select("arm", "ord")
    # one state row per arm (a proven bound): broadcast it on the build side of an inner join, so the
    # outcomes are never shuffled by arm (few arms = few huge keys); arms with no row come back from a
    # left join of two tiny tables
    hit = o.join(F.broadcast(st), (o["arm"] == st["arm"]) & (o["ord"] >= st["lo"]) & (o["ord"] < st["hi"]))
    cnt = hit.groupBy(st["arm"].alias("arm")).agg(F.count(F.lit(1)).alias("n_rows"))
    g = st.join(cnt, "arm", "left").select("arm", "lo", "hi", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    return g.withColumn("exhausted", F.col("n_rows") == 0)


def _gamma_sql(letter: str, shape: str) -> str:
    """The gamma sampler's first accepted attempt per arm, by 16 attempts next to each other."""
    def u(tag: str) -> str:
        return f"((CAST('0x' || substr(md5(concat_ws('|', concat('{SEED}|1|0|', CAST(arm AS VARCHAR), '|{letter}'), concat('{tag}', CAST(i AS VARCHAR)))), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)"

    return f"""{letter}0 AS (SELECT arm, i, {shape} - 1.0 / 3 AS d, sqrt(-2 * ln({u('r')})) * cos(2 * pi() * {u('t')}) AS x, ln({u('u')}) AS lu FROM par, range(16) r(i)),
{letter}1 AS (SELECT *, 1 + x / sqrt(9 * d) AS w FROM {letter}0),
{letter}2 AS (SELECT *, w * w * w AS v FROM {letter}1 WHERE w > 0),
{letter} AS (SELECT arm, arg_min(d * v, i) AS g FROM {letter}2 WHERE lu < 0.5 * x * x + d - d * v + d * ln(v) GROUP BY arm)"""


@register("e19_thompson_draws", views=("arm_outcomes",), sql=f"""
WITH {STATE_SQL},
acc AS (SELECT least(CAST(s AS DOUBLE) / n, 1 - 1e-9) AS p FROM state WHERE arm = {DEFAULT_ARM}),
par AS (SELECT arm, greatest(p / (1 - p) * {B.PRIOR_B}, {B.PRIOR_A_MIN}) + s AS alpha, {B.PRIOR_B} + n - s AS beta FROM state, acc),
{_gamma_sql('a', 'alpha')},
{_gamma_sql('b', 'beta')}
SELECT par.arm, round(alpha, 6) AS alpha, round(CAST(beta AS DOUBLE), 6) AS beta, round(a.g / (a.g + b.g), 6) AS draw FROM par JOIN a USING (arm) JOIN b USING (arm)""")
def e19_thompson_draws(spark, d):
    """One Thompson draw per arm from Beta(a0 + s, b0 + n - s), prior from the default arm; draws are functions of (seed, arm, step)."""
    st = _state(spark, d)
    acc0 = st.where(F.col("arm") == DEFAULT_ARM).select(F.first(F.col("s") / F.col("n"))).scalar()  # scalar subquery
    a0, b0 = B.prior(acc0)
    x = st.select("arm", (a0 + F.col("s")).alias("alpha"), (b0 + F.col("n") - F.col("s")).alias("beta"))
    return x.select("arm", "alpha", "beta", B.beta_draw(F.col("alpha"), F.col("beta"), B.draw_key(SEED, 1, 0, F.col("arm"))).alias("draw"))


@register("e20_ucb_scores", views=("arm_outcomes",), sql=f"""
WITH {STATE_SQL}
SELECT arm, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s,
       round(CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / n ELSE 0.0 END
             + CASE WHEN n > 0 THEN 2 * sqrt(ln(1 + {T_STEP}) / n) ELSE 0.0 END, 6) AS ucb
FROM state""")
def e20_ucb_scores(spark, d):
    """UCB score per arm (success ratio + exploration bonus)."""
    st = _state(spark, d)
    return st.select("arm", F.col("n").cast("bigint"), F.col("s").cast("bigint"),
                     B.ucb_score(F.col("s"), F.col("n"), F.lit(T_STEP)).alias("ucb"))


@register("e21_choose_arm", views=("arm_outcomes",), sql=f"""
WITH {STATE_SQL},
sc AS (SELECT arm, CASE WHEN n >= n_max THEN -1e9 ELSE CAST(s AS DOUBLE) / n + 2 * sqrt(ln(1 + {T_STEP}) / n) END AS score FROM state)
SELECT arm, round(score, 6) AS score FROM sc WHERE abs(score) < 1e9 ORDER BY score DESC, arm LIMIT 1""")
def e21_choose_arm(spark, d):
    """Next arm to evaluate (highest UCB); exhausted arms masked; empty when all exhausted."""
    st = _state(spark, d)
    sc = st.withColumn("score", B.masked(B.ucb_score(F.col("s"), F.col("n"), F.lit(T_STEP)), F.col("n"), F.col("n_max"),
                                         "highest"))
    return B.choose(sc, "score", "highest").select("arm", "score")


@register("e22_final_arm", views=("arm_outcomes",), sql=f"""
WITH {STATE_SQL},
t AS (SELECT arm, printf('arm_%02d', arm) AS label, CAST(s AS DOUBLE) / n AS acc FROM state WHERE n > 0),
hi AS (SELECT 'highest' AS objective, arm, acc FROM t ORDER BY acc DESC, label DESC LIMIT 1),
lo AS (SELECT 'lowest' AS objective, arm, acc FROM t ORDER BY acc ASC, label ASC LIMIT 1)
SELECT objective, arm, round(acc, 6) AS accuracy FROM hi UNION ALL SELECT objective, arm, round(acc, 6) AS accuracy FROM lo""")
def e22_final_arm(spark, d):
    """Best and worst tried arm by accuracy; ties by label in the sort's direction."""
    st = _state(spark, d).withColumn("label", F.format_string("arm_%02d", F.col("arm")))
    hi = B.final_arm(st, "highest").select(F.lit("highest").alias("objective"), "arm", F.col("acc").alias("accuracy"))
    lo = B.final_arm(st, "lowest").select(F.lit("lowest").alias("objective"), "arm", F.col("acc").alias("accuracy"))
    return hi.unionByName(lo)


@register("e23_two_phase_search", views=("arm_outcomes",))
def e23_two_phase_search(spark, d):
    """Two-phase Thompson search (best, then worst) over the arms; winners fully evaluated.

    Returns the step history plus the two winners' full-data accuracy.
    """
    bc = B.batch_counts(V.arm_outcomes(spark, d), ["arm"])
    found = B.two_phase_search(bc, DEFAULT_ARM, STEPS_PER_PHASE, SEED).select(F.explode("history").alias("h"), "best_arm", "worst_arm").select("h.*", "best_arm", "worst_arm")
    full = bc.groupBy("arm").agg((F.sum("s") / F.sum("n")).alias("full_accuracy"))
    b = full.select(F.col("arm").alias("best_arm"), F.col("full_accuracy").alias("best_full_accuracy"))
    w = full.select(F.col("arm").alias("worst_arm"), F.col("full_accuracy").alias("worst_full_accuracy"))
    return found.join(b, "best_arm", "left").join(w, "worst_arm", "left")
