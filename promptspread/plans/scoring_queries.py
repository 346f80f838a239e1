"""Queries E1-E16, E25 and F25 over the score / generation views (V2-V5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptspread.functions.text import (clean_text, normalize_generation, prefix_match, sql_clean,
                                         sql_normalize, sql_prefix_match)
from promptspread.operators import scoring as S
from promptspread.plans.registry import register
from promptspread.sources import views as V

ALPHA = 0.5          # sensitivity-aware weight of the real prompt
CAL_BATCH = 20       # evaluation batch size for batch calibration
EVAL_SEED = 37   # of the order in which instances are evaluated
VOTE_SEED = 7        # tie-break seed of the normalised vote
N_VARIANTS = 5       # formats in the text-generation view
ENS_SIZE = 3         # ensembles = 3 consecutive variants (cyclic)


def _text_ensembles(spark, d):
    """V4 rows fanned out to the cyclic ensembles their variant belongs to (no join)."""
    t = V.text_generations(spark, d)
    ens = F.array(*[(F.col("variant") - k + N_VARIANTS) % N_VARIANTS for k in range(ENS_SIZE)])
    return (t.select("*", F.explode(ens).alias("ensemble_id"))
            .withColumn("member_ord", (F.col("variant") - F.col("ensemble_id") + N_VARIANTS) % N_VARIANTS))


ENS_SQL = f"""ens AS (SELECT t.*, e.k, CAST((t.variant - e.k + {N_VARIANTS}) % {N_VARIANTS} AS INT) AS ensemble_id,
                     CAST(e.k AS INT) AS member_ord
              FROM text_generations t, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) e)"""


@register("e1_class_score", views=("token_scores",), sql="""
WITH m AS (SELECT *, max(logprob) OVER (PARTITION BY format_id, instance_id, pos_from_end) AS top FROM token_scores),
n AS (SELECT *, logprob - top - ln(sum(exp(logprob - top)) OVER (PARTITION BY format_id, instance_id, pos_from_end)) AS lp FROM m)
SELECT format_id, instance_id, class, round(sum(lp), 6) AS score
FROM n WHERE pos_from_end < answer_length GROUP BY format_id, instance_id, class""")
def e1_class_score(spark, d):
    """Raw scores to log-probs over the tokens of a position, then the sum over each class's trailing answer tokens."""
    tokens = S.log_softmax(V.token_scores(spark, d), ["format_id", "instance_id", "pos_from_end"], "logprob", "logprob")
    return S.class_score(tokens, ["format_id", "instance_id", "class"])


@register("e2_argmax_class", views=("class_scores",), sql="""
SELECT format_id, instance_id, class AS pred_class, round(score, 6) AS pred_score, answer
FROM (SELECT *, row_number() OVER (PARTITION BY format_id, instance_id ORDER BY score DESC, class) AS rn FROM class_scores) r
WHERE rn = 1""")
def e2_argmax_class(spark, d):
    """Argmax class per (format, instance); ties to the smallest class."""
    return S.argmax_class(V.class_scores(spark, d), ["format_id", "instance_id"], carry=["answer"])


@register("e3_class_token_shape", views=("instances",), sql="""
WITH c AS (SELECT DISTINCT task, answer FROM instances)
SELECT task, CAST(count(*) AS BIGINT) AS n_classes, bool_and(length(answer) = 1) AS single_token,
       count(DISTINCT substr(answer, 1, length(answer) - 1)) = 1 AS shared_prefix
FROM c GROUP BY task""")
def e3_class_token_shape(spark, d):
    """Per task, are all classes single-token / do all share the prefix before their last token?

    Tokens are characters here (no tokenizer in the engine).
    """
    c = V.instances_base(spark, d).select("task", "answer").distinct()
    return c.groupBy("task").agg(
        F.count(F.lit(1)).alias("n_classes"), F.bool_and(F.length("answer") == 1).alias("single_token"),
        (F.count_distinct(F.expr("substring(answer, 1, length(answer) - 1)")) == 1).alias("shared_prefix"))


@register("e4_batch_calibration", views=("token_scores",), sql=f"""
WITH o AS (SELECT instance_id, (row_number() OVER (ORDER BY md5(concat_ws('|', '{EVAL_SEED}', CAST(instance_id AS VARCHAR))), instance_id) - 1) // {CAL_BATCH} AS batch_no
           FROM (SELECT DISTINCT instance_id FROM token_scores)),
t AS (SELECT token_scores.*, batch_no FROM token_scores JOIN o USING (instance_id)),
ph AS (SELECT format_id, class, pos_from_end, batch_no, avg(logprob) AS p_hat FROM t GROUP BY ALL),
pr AS (SELECT *, avg(p_hat) OVER (PARTITION BY format_id, class, pos_from_end ORDER BY batch_no
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pr FROM ph),
cal AS (SELECT t.format_id, t.instance_id, t.class, sum(t.logprob - pr.pr) AS score
        FROM t JOIN pr USING (format_id, class, pos_from_end, batch_no)
        WHERE t.pos_from_end < t.answer_length GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY format_id, instance_id ORDER BY score DESC, class) AS rn FROM cal)
SELECT format_id, instance_id, class AS pred_class, round(score, 6) AS pred_score FROM r WHERE rn = 1""")
def e4_batch_calibration(spark, d):
    """Batch-calibrated class scores (running mean over batches of the evaluation order), then argmax."""
    tokens = V.token_scores(spark, d)
    cal = S.batch_calibrated_scores(tokens, S.evaluation_order(tokens, EVAL_SEED), CAL_BATCH)
    return S.argmax_class(cal, ["format_id", "instance_id"])


@register("e5_sensitivity_aware", views=("class_scores",), sql=f"""
WITH s AS (SELECT instance_id, class,
                  round({ALPHA} * max(CASE WHEN format_id = 0 THEN score END)
                        - {1 - ALPHA} * var_samp(CASE WHEN format_id > 0 THEN score END), 9) AS score
           FROM class_scores GROUP BY instance_id, class),
r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, class) AS rn FROM s)
SELECT instance_id, class AS pred_class, round(score, 6) AS pred_score FROM r WHERE rn = 1""")
def e5_sensitivity_aware(spark, d):
    """E5: real score penalised by the variance over perturbed copies (formats 1..5), argmax."""
    s = S.sensitivity_scores(V.class_scores(spark, d), ALPHA)
    return S.argmax_class(s, ["instance_id"])


@register("e6_probability_ensemble", views=("class_scores",), sql="""
WITH m AS (SELECT *, CAST(floor(format_id / 3) AS INT) AS ensemble_id,
                  exp(score - max(score) OVER (PARTITION BY format_id, instance_id)) AS e FROM class_scores),
sm AS (SELECT *, e / sum(e) OVER (PARTITION BY format_id, instance_id) AS p FROM m),
p AS (SELECT ensemble_id, instance_id, class, round(avg(p), 9) AS prob FROM sm GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ensemble_id, instance_id ORDER BY prob DESC, class) AS rn FROM p)
SELECT ensemble_id, instance_id, class AS pred_class, round(prob, 6) AS pred_score FROM r WHERE rn = 1""")
def e6_probability_ensemble(spark, d):
    """Average softmax over the formats of each ensemble (3 formats), argmax."""
    cs = V.class_scores(spark, d).withColumn("ensemble_id", F.floor(F.col("format_id") / 3).cast("int"))
    p = S.softmax_ensemble(cs, "ensemble_id")
    return S.argmax_class(p, ["ensemble_id", "instance_id"], score="prob")


@register("e7_clean_text", views=("text_generations",), sql=f"""
SELECT instance_id, variant, {sql_clean('generation')} AS clean_generation FROM text_generations""")
def e7_clean_text(spark, d):
    """Strip ' .,()\\n-><' then lower-case."""
    t = V.text_generations(spark, d)
    return t.select("instance_id", "variant", clean_text(F.col("generation")).alias("clean_generation"))


@register("e8_prefix_match", views=("text_generations",), sql=f"""
SELECT instance_id, variant, {sql_prefix_match(sql_clean('generation'), sql_clean('answer'))} AS is_match
FROM text_generations""")
def e8_prefix_match(spark, d):
    """Robust prefix match of the cleaned generation against the cleaned answer."""
    t = V.text_generations(spark, d)
    return t.select("instance_id", "variant",
                    prefix_match(clean_text(F.col("generation")), clean_text(F.col("answer"))).alias("is_match"))


FLAGS_SQL = f"""cls AS (SELECT DISTINCT answer AS c FROM text_generations),
flags AS (SELECT t.instance_id, t.variant,
                 coalesce({sql_prefix_match(sql_clean('t.generation'), sql_clean('t.answer'))}, false) AS "right",
                 EXISTS (SELECT 1 FROM cls WHERE cls.c <> t.answer
                         AND {sql_prefix_match(sql_clean('t.generation'), sql_clean('cls.c'))}) AS wrong
          FROM text_generations t)"""


def _flags(spark, d):
    t = V.text_generations(spark, d)
    # the class list is one global aggregate: a scalar subquery, evaluated once, no join
    classes = t.agg(F.sort_array(F.collect_set("answer"))).scalar()
    return S.match_flags(t.withColumn("classes", classes))


@register("e9_match_flags", views=("text_generations",), sql=f"""
WITH {FLAGS_SQL}
SELECT instance_id, variant, "right", wrong, NOT "right" AND NOT wrong AS other FROM flags""")
def e9_match_flags(spark, d):
    """Right / wrong / other per generation; wrong = matches any other class."""
    return _flags(spark, d).select("instance_id", "variant", "right", "wrong", "other")


@register("e10_ranking_flags", views=("class_scores",), sql="""
WITH a AS (SELECT format_id, instance_id, class AS pred, answer
           FROM (SELECT *, row_number() OVER (PARTITION BY format_id, instance_id ORDER BY score DESC, class) AS rn
                 FROM class_scores) r WHERE rn = 1),
cls AS (SELECT DISTINCT answer AS c FROM class_scores)
SELECT format_id, instance_id, pred = answer AS equal,
       pred <> answer AND pred IN (SELECT c FROM cls) AS wrong_in_classes,
       pred NOT IN (SELECT c FROM cls) AS not_in_classes
FROM a""")
def e10_ranking_flags(spark, d):
    """Ranking outcome flags: equal / other class / outside the class list."""
    cs = V.class_scores(spark, d)
    classes = cs.agg(F.sort_array(F.collect_set("answer"))).scalar()   # scalar subquery
    am = S.argmax_class(cs, ["format_id", "instance_id"], carry=["answer"]).withColumn("classes", classes)
    eq, wr, out = S.ranking_flags(F.col("pred_class"), F.col("answer"), F.col("classes"))
    return am.select("format_id", "instance_id", eq.alias("equal"), wr.alias("wrong_in_classes"),
                     out.alias("not_in_classes"))


@register("e11_accuracy_triple", views=("text_generations",), sql=f"""
WITH {FLAGS_SQL}
SELECT variant, round(CAST(count_if("right") AS DOUBLE) / greatest(count(*), 1), 6) AS right_ratio,
       round(CAST(count_if(wrong) AS DOUBLE) / greatest(count(*), 1), 6) AS wrong_ratio,
       CAST(count(*) AS BIGINT) AS total
FROM flags GROUP BY variant""")
def e11_accuracy_triple(spark, d):
    """(right ratio, wrong ratio, total) per format."""
    from promptspread.operators.metrics import accuracy_triple
    return accuracy_triple(_flags(spark, d), ["variant"])


@register("e12_majority_vote", views=("text_generations",), sql=f"""
WITH {ENS_SQL},
c AS (SELECT ensemble_id, instance_id, generation, count(*) AS votes, min(member_ord) AS first_ord
      FROM ens GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ensemble_id, instance_id ORDER BY votes DESC, first_ord) AS rn FROM c)
SELECT ensemble_id, instance_id, generation AS vote, CAST(votes AS BIGINT) AS votes FROM r WHERE rn = 1""")
def e12_majority_vote(spark, d):
    """Raw-text majority vote per (ensemble, instance); first-seen format wins ties."""
    return S.majority_vote(_text_ensembles(spark, d), ["ensemble_id", "instance_id"], "generation", "member_ord")


@register("e13_normalize_generation", views=("text_generations",), sql=f"""
SELECT instance_id, variant, {sql_normalize('generation')} AS normalized, {sql_normalize('generation', False)} AS plain FROM text_generations""")
def e13_normalize_generation(spark, d):
    """First word, clean, unicode escape; in multiple-choice tasks then Roman -> Latin -> fancy Roman -> number."""
    t = V.text_generations(spark, d)
    return t.select("instance_id", "variant", normalize_generation(F.col("generation")).alias("normalized"),
                    normalize_generation(F.col("generation"), False).alias("plain"))


# both kinds of tasks next to each other: a row votes once as a multiple-choice answer and once as plain text
VOTE_SQL = f"""{ENS_SQL},
nv AS (SELECT ensemble_id, instance_id, TRUE AS multiple_choice, {sql_normalize('generation')} AS g FROM ens
       UNION ALL SELECT ensemble_id, instance_id, FALSE, {sql_normalize('generation', False)} FROM ens),
c AS (SELECT ensemble_id, instance_id, multiple_choice, g, count(*) AS votes FROM nv GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ensemble_id, instance_id, multiple_choice ORDER BY votes DESC,
          md5(concat_ws('|', '{VOTE_SEED}', CAST(ensemble_id AS VARCHAR), CAST(instance_id AS VARCHAR), CAST(multiple_choice AS VARCHAR), g))) AS rn FROM c),
votes AS (SELECT ensemble_id, instance_id, multiple_choice, g AS vote, CAST(votes AS BIGINT) AS votes FROM r WHERE rn = 1)"""


def _both_kinds(df, value, out):
    """Rows once as multiple-choice answers and once as plain text."""
    g = F.array(F.struct(F.lit(True).alias("multiple_choice"), normalize_generation(F.col(value)).alias(out)),
                F.struct(F.lit(False).alias("multiple_choice"), normalize_generation(F.col(value), False).alias(out)))
    return df.withColumn("_k", F.explode(g)).select("*", "_k.*").drop("_k")


def _votes(spark, d):
    e = _both_kinds(_text_ensembles(spark, d), "generation", "g")
    return S.seeded_majority_vote(e, ["ensemble_id", "instance_id", "multiple_choice"], "g", VOTE_SEED)


@register("e14_seeded_vote", views=("text_generations",), sql=f"""
WITH {VOTE_SQL}
SELECT ensemble_id, instance_id, multiple_choice, vote, votes FROM votes""")
def e14_seeded_vote(spark, d):
    """Majority vote over normalised generations, seeded tie-break, for multiple-choice and other tasks."""
    return _votes(spark, d)


ANSWERS_SQL = f"""ans AS (SELECT DISTINCT instance_id, TRUE AS multiple_choice, {sql_normalize('answer')} AS a FROM text_generations
        UNION SELECT DISTINCT instance_id, FALSE, {sql_normalize('answer', False)} FROM text_generations)"""


@register("e15_vote_accuracy", views=("text_generations",), sql=f"""
WITH {VOTE_SQL}, {ANSWERS_SQL}
SELECT v.ensemble_id, coalesce(v.multiple_choice, ans.multiple_choice) AS multiple_choice, CAST(count(v.vote) AS BIGINT) AS n_predictions, CAST(count(ans.a) AS BIGINT) AS n_answers,
       round(avg(CASE WHEN v.vote = ans.a THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM votes v FULL OUTER JOIN ans ON v.instance_id = ans.instance_id AND v.multiple_choice = ans.multiple_choice
GROUP BY ALL""")
def e15_vote_accuracy(spark, d):
    """Ensemble accuracy against normalised answers, with a count audit (full outer join)."""
    votes = _votes(spark, d)
    ans = _both_kinds(V.text_generations(spark, d).select("instance_id", "answer").distinct(), "answer", "a").select("instance_id", "multiple_choice", "a").distinct()
    j = votes.join(ans, ["instance_id", "multiple_choice"], "full_outer")
    return j.groupBy("ensemble_id", "multiple_choice").agg(
        F.count("vote").alias("n_predictions"), F.count("a").alias("n_answers"),
        F.avg(F.when(F.col("vote") == F.col("a"), 1.0).otherwise(0.0)).alias("accuracy"))


@register("e16_top_k_scores", views=("class_scores",), sql="""
SELECT format_id, instance_id, class, round(score, 6) AS score, CAST(rn AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY format_id, instance_id ORDER BY score DESC, class) AS rn
      FROM class_scores) r WHERE rn <= 100""")
def e16_top_k_scores(spark, d, k=100):
    """Top-k classes per (format, instance), 100 by default - the feature is the top-k report."""
    t = S.top_k(V.class_scores(spark, d), ["format_id", "instance_id"], k)
    return t.select("format_id", "instance_id", "class", "score", "rank")


@register("e25_prediction_log", views=("instances",), sql="""
WITH cls AS (SELECT task, array_to_string(list_sort(list(DISTINCT answer)), ',') AS output_classes
             FROM instances GROUP BY task),
g AS (SELECT task, instance_id, input, answer, concat(input, ' => ', upper(answer)) AS raw FROM instances)
SELECT g.task, g.instance_id, substr(g.raw, length(g.input) + 1) AS generation, g.answer, cls.output_classes
FROM g JOIN cls USING (task)""")
def e25_prediction_log(spark, d):
    """Cut the echoed prompt from the generation; attach gold answer and the class list.

    The generation echoes the whole input (as a decoder model would) followed by an answer.
    """
    inst = V.instances_base(spark, d)
    cls = S.output_classes(inst, ["task"]).select("task", F.array_join("classes", ",").alias("output_classes"))
    g = inst.withColumn("raw", F.concat("input", F.lit(" => "), F.upper("answer")))
    return g.join(cls, "task").select("task", "instance_id", S.strip_echo(F.col("raw"), F.col("input")).alias("generation"),
                                      "answer", "output_classes")


@register("f25_api_summary", views=("text_generations",), sql=f"""
WITH {VOTE_SQL}, {ANSWERS_SQL},
single AS (SELECT t.variant AS unit, avg(CASE WHEN {sql_normalize('t.generation')} = ans.a THEN 1.0 ELSE 0.0 END) AS acc
           FROM text_generations t JOIN ans USING (instance_id) WHERE ans.multiple_choice GROUP BY t.variant),
ensemble AS (SELECT v.ensemble_id AS unit, avg(CASE WHEN v.vote = ans.a THEN 1.0 ELSE 0.0 END) AS acc
             FROM votes v JOIN ans ON ans.instance_id = v.instance_id AND ans.multiple_choice WHERE v.multiple_choice GROUP BY v.ensemble_id),
u AS (SELECT 'single' AS kind, acc FROM single UNION ALL SELECT 'ensemble' AS kind, acc FROM ensemble)
SELECT kind, round(max(acc) - min(acc), 6) AS spread, round(stddev_samp(acc), 6) AS std_accuracy,
       round(avg(acc), 6) AS mean_accuracy, round(median(acc), 6) AS median_accuracy
FROM u GROUP BY kind""")
def f25_api_summary(spark, d):
    """spread / std / mean / median of accuracy for single formats and for ensembles (multiple choice)."""
    t = V.text_generations(spark, d)
    ans = t.select("instance_id", normalize_generation(F.col("answer")).alias("a")).distinct()
    single = (t.join(ans, "instance_id")
              .groupBy(F.col("variant").alias("unit"))
              .agg(F.avg(F.when(normalize_generation(F.col("generation")) == F.col("a"), 1.0).otherwise(0.0)).alias("acc"))
              .withColumn("kind", F.lit("single")))
    ens = (_votes(spark, d).where("multiple_choice").join(ans, "instance_id")
           .groupBy(F.col("ensemble_id").alias("unit"))
           .agg(F.avg(F.when(F.col("vote") == F.col("a"), 1.0).otherwise(0.0)).alias("acc"))
           .withColumn("kind", F.lit("ensemble")))
    u = single.unionByName(ens)
    return u.groupBy("kind").agg(
        (F.max("acc") - F.min("acc")).alias("spread"), F.stddev_samp("acc").alias("std_accuracy"),
        F.avg("acc").alias("mean_accuracy"), F.median("acc").alias("median_accuracy"))
