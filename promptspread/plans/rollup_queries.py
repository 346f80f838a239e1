"""Queries F12-F35 over the task-record view (V8) and derived experiment names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from promptspread.operators import rollup as R
from promptspread.plans.registry import register
from promptspread.sources import views as V
from promptspread.sources.tables import table

N_TASKS = 13          # tasks per experiment in the task-record view
TASKS_PER_UNIT = 52   # the reference's task-set size (F31)
TOP_TASKS = 5
SUBSET = ["task1", "task3", "task5", "task7"]
ENSEMBLE_METHOD, SINGLE_METHOD = "FURNITURE", "AUTOMOBILE"

# Experiment names derived from V8 (model index -> model name, segment -> run tail).
MODEL_NAMES = ["Llama-3.2-1B-Instruct", "Qwen2.5-3B-Instruct", "gemma-2-9b-it", "Qwen2.5-1.5B-Instruct_lora"]
METHOD_TAILS = {"AUTOMOBILE": "2-shot", "BUILDING": "batch-calibration-2-shot", "FURNITURE": "template-ensembles-2-shot",
                "HOUSEHOLD": "sensitivity-aware-decoding-2-shot", "MACHINERY": "iidx2-0-shot"}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def experiments(spark, d):
    """Task records with an experiment name ``Model---tail`` (one name per model x method x setting)."""
    tr = V.task_records(spark, d)
    model = F.element_at(F.array(*[F.lit(m) for m in MODEL_NAMES]), F.substring("model", 2, 9).cast("int") + 1)
    tail = F.lit(None).cast("string")
    for k, v in METHOD_TAILS.items():
        tail = F.when(F.col("method") == k, F.lit(v)).otherwise(tail)
    comp = F.when(F.col("setting") == "compositional", F.lit("compositional-")).otherwise(F.lit(""))
    return tr.withColumn("experiment", F.concat(model, F.lit("---no-chat-template-"), comp, tail))


EXP_SQL = ("experiments AS (SELECT *, concat(" + "[" + ", ".join(q(m) for m in MODEL_NAMES) + "]"
           "[CAST(substr(model, 2) AS INT) + 1], '---no-chat-template-', "
           "CASE WHEN setting = 'compositional' THEN 'compositional-' ELSE '' END, CASE method "
           + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in METHOD_TAILS.items()) + " END) AS experiment FROM task_records)")


def rewrite_sql(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ''), lambda c, i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substr({x}, i - 1, 1), '\\p{{L}}') THEN upper(c) ELSE lower(c) END), '')")


def size_sql(x: str) -> str:
    arms = " ".join(f"WHEN contains({x}, {q(m)}) THEN {s}" for m, s in R.SIZE_MARKERS)
    return f"CAST(CASE {arms} END AS DOUBLE)"


def parse_sql(name: str) -> dict[str, str]:
    model = f"split_part({name}, '---', 1)"
    tail = f"split_part({name}, '---', 2)"
    setting = "CASE " + " ".join(f"WHEN contains({tail}, {q(m)}) THEN {q(v)}" for m, v in R.SETTING_MARKERS) + " ELSE 'uniform' END"
    t = rewrite_sql(tail, R.COMMON_TAIL_REWRITES)
    icl = rewrite_sql(t, R.ICL_TAIL_REWRITES)
    method = (f"CASE WHEN contains({model}, 'lora') THEN concat('LoRA', {rewrite_sql(t, R.LORA_TAIL_REWRITES)}) "
              f"WHEN {icl} IN ('', '-') THEN 'FS' ELSE {icl} END")
    base = f"CASE WHEN contains({model}, 'lora') THEN replace({model}, '_lora', '') ELSE {model} END"
    display = title_sql(rewrite_sql(base, R.MODEL_REWRITES))
    return {"model": display, "method": method, "setting": setting, "size": size_sql(display)}


def keep_sql(n: str) -> str:
    parts = [f"NOT contains({n}, {q(m)})" for m in R.EXCLUDED_MARKERS]
    parts.append(f"contains({n}, 'no-chat-template')")
    parts.append(f"((contains({n}, '2-shot') AND NOT contains({n}, 'lora')) OR (contains({n}, '0-shot') AND contains({n}, 'lora')))")
    parts.append(f"(contains(lower({n}), 'instruct') OR contains({n}, 'it'))")
    parts.append("(" + " OR ".join(f"contains({n}, {q(f)})" for f in R.SELECTED_FAMILIES) + ")")
    return "(" + " AND ".join(parts) + ")"


@register("f12_union_task_records", views=("task_records",), sql="""
SELECT model, method, setting, task, CAST(n AS BIGINT) AS n, round(median_accuracy, 6) AS median_accuracy,
       round(spread_accuracy, 6) AS spread_accuracy FROM task_records""")
def f12_union_task_records(spark, d):
    """union of per-experiment task records (by name, one per setting slice)."""
    tr = V.task_records(spark, d)
    return tr.where(F.col("setting") == "uniform").unionByName(tr.where(F.col("setting") != "uniform"))


@register("f13_experiment_filter", views=("task_records",), sql=f"""
WITH {EXP_SQL}
SELECT DISTINCT experiment, {keep_sql('experiment')} AS keep FROM experiments""")
def f13_experiment_filter(spark, d):
    """the reference's experiment-name filters as one boolean column."""
    e = experiments(spark, d).select("experiment").distinct()
    return e.select("experiment", R.experiment_keep(F.col("experiment")).alias("keep"))


@register("f14_parse_experiment", views=("task_records",), sql=f"""
WITH {EXP_SQL}, e AS (SELECT DISTINCT experiment FROM experiments)
SELECT experiment, {parse_sql('experiment')['model']} AS model_name, {parse_sql('experiment')['method']} AS method_name,
       {parse_sql('experiment')['setting']} AS setting_name, {parse_sql('experiment')['size']} AS size
FROM e""")
def f14_parse_experiment(spark, d):
    """model display name, method handle, setting and model size parsed from the experiment name."""
    e = experiments(spark, d).select("experiment").distinct()
    p = R.parse_experiment(F.col("experiment"))
    return e.select("experiment", p["model"].alias("model_name"), p["method"].alias("method_name"),
                    p["setting"].alias("setting_name"), p["size"].alias("size"))


@register("f15_task_from_file_name", sql="""
SELECT regexp_extract(f, '(task[0-9]+)', 1) AS task_id, CAST(count(*) AS BIGINT) AS n_files
FROM (SELECT concat('metadataholistic_textdisabled_rankscore_task', CAST(c_custkey % 13 AS VARCHAR),
                    '_search_model_', c_mktsegment, '_nshot_2.json') AS f FROM customer) t
GROUP BY 1""")
def f15_task_from_file_name(spark, d):
    """task id = the first underscore-separated part containing 'task' of a result file name."""
    c = table(spark, d, "customer")
    f = F.concat(F.lit("metadataholistic_textdisabled_rankscore_task"), (F.col("c_custkey") % 13).cast("string"),
                 F.lit("_search_model_"), F.col("c_mktsegment"), F.lit("_nshot_2.json"))
    parts = F.filter(F.split(f, "_"), lambda p: p.contains("task"))
    return (c.select(F.regexp_extract(parts[0], "(task[0-9]+)", 1).alias("task_id"))
            .groupBy("task_id").agg(F.count(F.lit(1)).alias("n_files")))


@register("f16_completeness", views=("task_records",), sql=f"""
WITH {EXP_SQL},
h AS (SELECT experiment, n, count(*) AS files FROM experiments GROUP BY experiment, n),
g AS (SELECT experiment, string_agg(concat(n, ':', files), ',' ORDER BY n) AS formats_histogram FROM h GROUP BY experiment)
SELECT e.experiment, CAST(count(DISTINCT e.task) AS BIGINT) AS n_tasks, count(DISTINCT e.task) = {N_TASKS} AS complete, any_value(formats_histogram) AS formats_histogram
FROM experiments e JOIN g ON g.experiment = e.experiment GROUP BY e.experiment""")
def f16_completeness(spark, d):
    """F16: tasks evaluated per experiment against the expected number, and how many files hold how many evaluated formats."""
    e = experiments(spark, d)
    # as many entries as there are different numbers of formats
    per = e.groupBy("experiment", "n").agg(F.count("*").alias("files")).groupBy("experiment").agg(
        F.array_sort(F.collect_list(F.struct("n", F.concat_ws(":", F.col("n").cast("string"), F.col("files").cast("string")).alias("t")))).alias("h"))
    per = per.select("experiment", F.array_join(F.transform("h", lambda x: x["t"]), ",").alias("formats_histogram"))
    g = e.groupBy("experiment").agg(F.count_distinct("task").alias("n_tasks")).withColumn("complete", F.col("n_tasks") == N_TASKS)
    return g.join(per, "experiment")


@register("f17_average_rank", views=("task_records",), sql="""
WITH r AS (SELECT *, rank() OVER (PARTITION BY model, setting, task ORDER BY median_accuracy DESC)
                     + (count(*) OVER (PARTITION BY model, setting, task, median_accuracy) - 1) / 2.0 AS rnk
           FROM task_records)
SELECT setting, method, round(avg(rnk), 6) AS mean_rank FROM r GROUP BY setting, method""")
def f17_average_rank(spark, d):
    """rank methods within (model, setting, task), ties averaged; mean rank per setting x method."""
    r = R.average_rank(V.task_records(spark, d), ["model", "setting", "task"], "median_accuracy", True)
    return r.groupBy("setting", "method").agg(F.avg("rank").alias("mean_rank"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("f18_pivot_methods", views=("task_records",), sql="""
SELECT setting, """ + ", ".join(f"round(avg(CASE WHEN method = '{s}' THEN median_accuracy END), 6) AS {s}" for s in SEGMENTS) + """
FROM task_records GROUP BY setting""")
def f18_pivot_methods(spark, d):
    """unstack mean accuracy by method (explicit pivot values: no extra distinct job)."""
    return V.task_records(spark, d).groupBy("setting").pivot("method", SEGMENTS).avg("median_accuracy")


@register("f19_mean_pm_std", views=("task_records",), sql="""
SELECT model, method, round(avg(median_accuracy), 6) AS mean_median, round(avg(spread_accuracy), 6) AS mean_std,
       printf('%.3f ± %.3f', avg(median_accuracy), 2 * avg(spread_accuracy)) AS display
FROM task_records GROUP BY model, method""")
def f19_mean_pm_std(spark, d):
    """per model x method, mean of medians and of std (spread stands in), shown as m ± 2·std."""
    g = V.task_records(spark, d).groupBy("model", "method").agg(
        F.avg("median_accuracy").alias("mean_median"), F.avg("spread_accuracy").alias("mean_std"))
    return g.withColumn("display", F.format_string("%.3f ± %.3f", F.col("mean_median"), 2 * F.col("mean_std")))


@register("f20_category_order", views=("task_records",), sql=f"""
WITH {EXP_SQL}, e AS (SELECT DISTINCT experiment FROM experiments),
p AS (SELECT experiment, {parse_sql('experiment')['method']} AS method_name, {parse_sql('experiment')['size']} AS size FROM e),
o AS (SELECT *, CASE WHEN list_position({'[' + ', '.join(q(m) for m in R.METHOD_ORDER) + ']'}, method_name) IS NULL
                     THEN {len(R.METHOD_ORDER) + 1} ELSE list_position({'[' + ', '.join(q(m) for m in R.METHOD_ORDER) + ']'}, method_name) END AS method_pos FROM p)
SELECT experiment, method_name, size, CAST(method_pos AS INT) AS method_pos,
       CAST(row_number() OVER (ORDER BY method_pos, size, experiment) AS INT) AS sort_position FROM o""")
def f20_category_order(spark, d):
    """order experiments by the fixed method order, then model size."""
    e = experiments(spark, d).select("experiment").distinct()
    p = R.parse_experiment(F.col("experiment"))
    x = e.select("experiment", p["method"].alias("method_name"), p["size"].alias("size"))
    x = x.withColumn("method_pos", R.method_order_index(F.col("method_name")).cast("int"))
    w = Window.orderBy("method_pos", "size", "experiment")   # one row per experiment: small
    return x.withColumn("sort_position", F.row_number().over(w))


@register("f21_pareto_front", views=("task_records",), sql="""
WITH g AS (SELECT setting, model, method, avg(median_accuracy) AS acc, avg(spread_accuracy) AS spread
           FROM task_records GROUP BY setting, model, method),
w AS (SELECT *, min(spread) OVER (PARTITION BY setting ORDER BY acc DESC, spread ASC
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_min FROM g)
SELECT setting, model, method, round(acc, 6) AS acc, round(spread, 6) AS spread FROM w
WHERE prev_min IS NULL OR spread < prev_min""")
def f21_pareto_front(spark, d):
    """Pareto front per setting of (mean accuracy up, mean spread down) over model x method."""
    g = V.task_records(spark, d).groupBy("setting", "model", "method").agg(
        F.avg("median_accuracy").alias("acc"), F.avg("spread_accuracy").alias("spread"))
    return R.pareto_front(g, ["setting"], "acc", "spread")


@register("f22_covariance_ellipse", views=("task_records",), sql="""
WITH g AS (SELECT method, avg(median_accuracy) AS mean_x, avg(spread_accuracy) AS mean_y,
                  var_samp(median_accuracy) AS a, covar_samp(median_accuracy, spread_accuracy) AS b,
                  var_samp(spread_accuracy) AS c FROM task_records GROUP BY method),
e AS (SELECT *, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS lo, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS hi FROM g),
v AS (SELECT *, degrees(atan2(CASE WHEN b <> 0 THEN lo - a WHEN a <= c THEN 0.0 ELSE 1.0 END,
                              CASE WHEN b <> 0 THEN b WHEN a <= c THEN 1.0 ELSE 0.0 END)) AS ang FROM e)
SELECT method, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, round(a, 6) AS cov_xx, round(b, 6) AS cov_xy,
       round(c, 6) AS cov_yy, round(6 * sqrt(greatest(lo, 0.0)), 6) AS width, round(6 * sqrt(greatest(hi, 0.0)), 6) AS height,
       round(CASE WHEN ang < 0 THEN ang + 180 WHEN ang >= 180 THEN ang - 180 ELSE ang END, 6) AS angle
FROM v""")
def f22_covariance_ellipse(spark, d):
    """per method, mean (accuracy, spread), 2x2 covariance, axes of the three-sigma ellipse and angle."""
    return R.covariance_ellipse(V.task_records(spark, d), ["method"], "median_accuracy", "spread_accuracy")


@register("f23_mean_with_first", views=("task_records",), sql="""
SELECT model, method, round(avg(median_accuracy), 6) AS mean_accuracy, arg_min(setting, task) AS setting,
       min(task) AS first_task FROM task_records GROUP BY model, method""")
def f23_mean_with_first(spark, d):
    """group mean joined with the first row's attributes - one aggregate, min_by."""
    return V.task_records(spark, d).groupBy("model", "method").agg(
        F.avg("median_accuracy").alias("mean_accuracy"), F.min_by("setting", "task").alias("setting"),
        F.min("task").alias("first_task"))


@register("f24_sqrt_histogram", views=("task_records",), sql="""
WITH w AS (SELECT model, method, spread_accuracy AS v, count(*) OVER (PARTITION BY model, method) AS n,
                  min(spread_accuracy) OVER (PARTITION BY model, method) AS lo,
                  max(spread_accuracy) OVER (PARTITION BY model, method) AS hi FROM task_records),
b AS (SELECT model, method, CAST(ceil(sqrt(n)) AS INT) AS n_bins,
             CAST(least(CASE WHEN hi = lo THEN 0 ELSE floor((v - lo) / (hi - lo) * ceil(sqrt(n))) END, ceil(sqrt(n)) - 1) AS INT) AS bin
      FROM w)
SELECT model, method, n_bins, bin, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL""")
def f24_sqrt_histogram(spark, d):
    """spread histogram per experiment with ceil(sqrt(n)) equal-width bins."""
    return R.sqrt_bins_histogram(V.task_records(spark, d), ["model", "method"], "spread_accuracy")


@register("f26_model_method_table", views=("task_records",), sql="""
SELECT model, method, round(avg(median_accuracy), 4) AS accuracy, round(avg(spread_accuracy), 4) AS spread,
       CAST(count(*) AS BIGINT) AS n_tasks FROM task_records GROUP BY model, method""")
def f26_model_method_table(spark, d):
    """model x method summary, rounded to 4 digits."""
    return V.task_records(spark, d).groupBy("model", "method").agg(
        F.round(F.avg("median_accuracy"), 4).alias("accuracy"), F.round(F.avg("spread_accuracy"), 4).alias("spread"),
        F.count(F.lit(1)).alias("n_tasks"))


@register("f27_ensemble_change", views=("task_records",), sql=f"""
WITH p AS (SELECT model, setting, task, max(CASE WHEN method = '{ENSEMBLE_METHOD}' THEN spread_accuracy END) AS ens,
                  max(CASE WHEN method = '{SINGLE_METHOD}' THEN spread_accuracy END) AS single
           FROM task_records GROUP BY model, setting, task)
SELECT model, setting, task, round(ens - single, 6) AS abs_change,
       round(CASE WHEN single <> 0 THEN (ens - single) / single END, 6) AS rel_change
FROM p WHERE ens IS NOT NULL AND single IS NOT NULL""")
def f27_ensemble_change(spark, d):
    """absolute and relative change of spread, ensemble method vs single format (pivot, no self-join)."""
    p = V.task_records(spark, d).groupBy("model", "setting", "task").agg(
        F.max(F.when(F.col("method") == ENSEMBLE_METHOD, F.col("spread_accuracy"))).alias("ens"),
        F.max(F.when(F.col("method") == SINGLE_METHOD, F.col("spread_accuracy"))).alias("single"))
    p = p.where(F.col("ens").isNotNull() & F.col("single").isNotNull())
    return p.select("model", "setting", "task", (F.col("ens") - F.col("single")).alias("abs_change"),
                    F.when(F.col("single") != 0, (F.col("ens") - F.col("single")) / F.col("single")).alias("rel_change"))


FMT_LEN_SQL = """fl AS (SELECT concat('task', CAST(c_custkey % 13 AS VARCHAR(4))) AS task,
                        CAST(count(DISTINCT c_nationkey) % 7 + 2 AS INT) AS format_length
                 FROM customer GROUP BY 1)"""


def _format_length(spark, d):
    c = table(spark, d, "customer")
    return (c.groupBy(F.concat(F.lit("task"), (F.col("c_custkey") % 13).cast("string")).alias("task"))
            .agg((F.count_distinct("c_nationkey") % 7 + 2).cast("int").alias("format_length")))


@register("f28_attach_format_length", views=("task_records",), sql=f"""
WITH {FMT_LEN_SQL}
SELECT t.model, t.method, t.setting, t.task, round(t.spread_accuracy, 6) AS spread_accuracy, fl.format_length
FROM task_records t LEFT JOIN fl USING (task)""")
def f28_attach_format_length(spark, d):
    """attach each task's format length (slot count) to the task records - left join on task."""
    tr = V.task_records(spark, d)
    return tr.join(_format_length(spark, d), "task", "left").select(
        "model", "method", "setting", "task", "spread_accuracy", "format_length")


@register("f29_spread_by_length", views=("task_records",), sql=f"""
WITH {EXP_SQL}, {FMT_LEN_SQL},
j AS (SELECT 'format_length' AS grouped_by, CAST(fl.format_length AS DOUBLE) AS value, spread_accuracy FROM task_records t LEFT JOIN fl USING (task) WHERE t.setting = 'uniform'
      UNION ALL SELECT 'size', {parse_sql('experiment')['size']}, spread_accuracy FROM experiments WHERE setting = 'uniform'),
g AS (SELECT grouped_by, value, avg(spread_accuracy) AS mean, stddev_samp(spread_accuracy) AS std, quantile_cont(spread_accuracy, 0.05) AS q05, quantile_cont(spread_accuracy, 0.95) AS q95
      FROM j GROUP BY grouped_by, value)
SELECT grouped_by, value, round(mean, 6) AS mean, round(std, 6) AS std, round(q05, 6) AS q05, round(q95, 6) AS q95, round(mean - q05, 6) AS lower_error, round(q95 - mean, 6) AS upper_error FROM g""")
def f29_spread_by_length(spark, d):
    """mean, std and 90 % interval (linear quantiles) of spread by format length and by model size (uniform setting)."""
    uniform = F.col("setting") == "uniform"
    by_length = V.task_records(spark, d).where(uniform).join(_format_length(spark, d), "task", "left").select(
        F.lit("format_length").alias("grouped_by"), F.col("format_length").cast("double").alias("value"), "spread_accuracy")
    by_size = experiments(spark, d).where(uniform).select(F.lit("size").alias("grouped_by"), R.parse_experiment(F.col("experiment"))["size"].cast("double").alias("value"), "spread_accuracy")
    g = by_length.unionByName(by_size).groupBy("grouped_by", "value").agg(
        F.avg("spread_accuracy").alias("mean"), F.stddev_samp("spread_accuracy").alias("std"),
        F.percentile("spread_accuracy", 0.05).alias("q05"), F.percentile("spread_accuracy", 0.95).alias("q95"))
    return g.withColumn("lower_error", F.col("mean") - F.col("q05")).withColumn("upper_error", F.col("q95") - F.col("mean"))


@register("f30_top_tasks_by_spread", views=("task_records",), sql=f"""
WITH g AS (SELECT setting, task, avg(spread_accuracy) AS spread FROM task_records GROUP BY setting, task),
r AS (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY spread DESC, task) AS rn FROM g)
SELECT setting, task, round(spread, 6) AS spread, CAST(rn AS INT) AS rank FROM r WHERE rn <= {TOP_TASKS}""")
def f30_top_tasks_by_spread(spark, d):
    """the 5 tasks with the largest mean spread per setting (top-k report)."""
    g = V.task_records(spark, d).groupBy("setting", "task").agg(F.avg("spread_accuracy").alias("spread"))
    w = Window.partitionBy("setting").orderBy(F.col("spread").desc(), "task")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_TASKS)


@register("f31_counts_by_setting", views=("task_records",), sql=f"""
SELECT setting, CAST(count(*) AS BIGINT) AS n_rows, round(count(*) / {TASKS_PER_UNIT}.0, 6) AS n_units
FROM task_records GROUP BY setting""")
def f31_counts_by_setting(spark, d):
    """task-record rows per setting, also in units of the 52-task set."""
    return V.task_records(spark, d).groupBy("setting").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) / float(TASKS_PER_UNIT)).alias("n_units"))


@register("f32_class_entropy", views=("instances",), sql="""
WITH c AS (SELECT task, answer, count(*) AS n FROM instances GROUP BY task, answer),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY task) AS p FROM c)
SELECT task, CAST(count(*) AS BIGINT) AS n_classes, CAST(sum(n) AS BIGINT) AS n_rows,
       round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) END, 6) AS normalized_entropy
FROM p GROUP BY task""")
def f32_class_entropy(spark, d):
    """F32: class counts and normalised entropy of the answers per task."""
    return R.normalized_entropy(V.instances_base(spark, d), ["task"], "answer")


@register("f33_task_size_distribution", views=("instances",), sql="""
SELECT task_size, CAST(count(*) AS BIGINT) AS n_tasks
FROM (SELECT task, count(*) AS task_size FROM instances GROUP BY task) t GROUP BY task_size""")
def f33_task_size_distribution(spark, d):
    """distribution of task sizes (instances per task)."""
    s = V.instances_base(spark, d).groupBy("task").agg(F.count(F.lit(1)).alias("task_size"))
    return s.groupBy("task_size").agg(F.count(F.lit(1)).alias("n_tasks"))


def _cat_sql(n: str) -> str:
    fam = "CASE " + " ".join(f"WHEN starts_with({n}, {q(f)}) THEN {q(f)}" for f in R.CATALOGUE_FAMILIES) + " ELSE '?' END"
    size = "CASE " + " ".join(f"WHEN contains({n}, {q(s)}) THEN {q(s)}" for s in R.CATALOGUE_SIZES) + " ELSE '?' END"
    method = (f"CASE WHEN contains({n}, 'lora') AND contains({n}, 'iidx2') THEN 'lora' WHEN contains({n}, 'lora') THEN 'lora_shift' "
              f"WHEN contains({n}, 'default') THEN 'default_format' WHEN contains({n}, 'sensitivity-aware-decoding') THEN 'sensitivity-aware-decoding' "
              f"WHEN contains({n}, 'template-ensembles') THEN 'template-ensembles' WHEN contains({n}, 'batch-calibration-probs') THEN 'batch-calibration-probs' "
              f"WHEN contains({n}, 'batch-calibration') THEN 'batch-calibration' ELSE 'none' END")
    return (f"{fam} AS family, {size} AS size, CASE WHEN contains({n}, 'Instruct') OR contains({n}, 'it') THEN 'Instruct' ELSE 'Base' END AS instruct, "
            f"CASE WHEN contains({n}, '2-shot') THEN '2' WHEN contains({n}, '0-shot') THEN '0' ELSE '?' END AS shots, "
            f"CASE WHEN contains({n}, 'no-chat-template') THEN 'no' ELSE 'chat-template' END AS template, "
            f"CASE WHEN contains({n}, 'iid') THEN 'iid' ELSE 'compositional' END AS split, {method} AS method")


@register("f34_experiment_catalogue", views=("task_records",), sql=f"""
WITH {EXP_SQL}, e AS (SELECT experiment, CAST(count(DISTINCT task) AS BIGINT) AS n_tasks_evaluated FROM experiments GROUP BY experiment), k AS (SELECT experiment, {_cat_sql('experiment')}, n_tasks_evaluated FROM e)
SELECT *, CASE WHEN template = 'no' AND shots IN ('0', '2') AND instruct = 'Instruct'
  THEN CAST(row_number() OVER (PARTITION BY template = 'no' AND shots IN ('0', '2') AND instruct = 'Instruct' ORDER BY family, size, shots, method, experiment) AS INT) END AS listed FROM k""")
def f34_experiment_catalogue(spark, d):
    """experiment catalogue (family, size, instruct, shots, template, split, method, tasks evaluated), and the place of
    the experiments that pass the filter (no template, 0 or 2 shots, instruct) in the sorted list."""
    e = experiments(spark, d).groupBy("experiment").agg(F.count_distinct("task").alias("n_tasks_evaluated"))
    n = F.col("experiment")

    def first_match(values, test, default="?"):
        out = F.lit(default)
        for v in reversed(values):
            out = F.when(test(v), F.lit(v)).otherwise(out)
        return out

    method = (F.when(n.contains("lora") & n.contains("iidx2"), "lora").when(n.contains("lora"), "lora_shift")
              .when(n.contains("default"), "default_format")
              .when(n.contains("sensitivity-aware-decoding"), "sensitivity-aware-decoding")
              .when(n.contains("template-ensembles"), "template-ensembles")
              .when(n.contains("batch-calibration-probs"), "batch-calibration-probs")
              .when(n.contains("batch-calibration"), "batch-calibration").otherwise("none"))
    k = e.select(
        "experiment", first_match(R.CATALOGUE_FAMILIES, lambda f: n.startswith(f)).alias("family"),
        first_match(R.CATALOGUE_SIZES, lambda s: n.contains(s)).alias("size"),
        F.when(n.contains("Instruct") | n.contains("it"), "Instruct").otherwise("Base").alias("instruct"),
        F.when(n.contains("2-shot"), "2").when(n.contains("0-shot"), "0").otherwise("?").alias("shots"),
        F.when(n.contains("no-chat-template"), "no").otherwise("chat-template").alias("template"),
        F.when(n.contains("iid"), "iid").otherwise("compositional").alias("split"),
        method.alias("method"), "n_tasks_evaluated")
    passes = (F.col("template") == "no") & F.col("shots").isin("0", "2") & (F.col("instruct") == "Instruct")
    # over the distinct experiments, a few hundred at most
    place = F.row_number().over(Window.partitionBy(passes).orderBy("family", "size", "shots", "method", "experiment"))
    return k.withColumn("listed", F.when(passes, place))


@register("f35_subset_means", views=("task_records",), sql=f"""
WITH {EXP_SQL}
SELECT model, method, round(avg(median_accuracy), 6) AS mean_accuracy, round(avg(spread_accuracy), 6) AS mean_spread,
       {parse_sql('any_value(experiment)')['size']} AS size
FROM experiments WHERE task IN ({', '.join(q(t) for t in SUBSET)}) GROUP BY model, method""")
def f35_subset_means(spark, d):
    """means over a task subset by model and method, with the model size for sorting."""
    e = experiments(spark, d).where(F.col("task").isin(SUBSET))
    g = e.groupBy("model", "method").agg(F.avg("median_accuracy").alias("mean_accuracy"),
                                         F.avg("spread_accuracy").alias("mean_spread"),
                                         F.first("experiment").alias("__e"))
    return g.select("model", "method", "mean_accuracy", "mean_spread",
                    R.parse_experiment(F.col("__e"))["size"].alias("size"))
