"""Roll-up operators over task records.

Task records are already aggregated (one row per model x method x setting x
task), so the windows here run over small partitions; every function is still
a plain DataFrame transformation that would run unchanged on a large table.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptspread.functions.text import sql_map_case  # noqa: F401  (re-exported for SQL twins)

# Fixed values (must equal the reference): method display order and model-size markers.
METHOD_ORDER = ["FS", "BC", "SAD", "TE", "LoRA", "LoRA (compositional)", "LoRA (cross-domain)",
                "LoRA (consistency)", "(new) TE"]
SIZE_MARKERS = [("1B", 1.0), ("1.5B", 1.5), ("2b", 2.0), ("2B", 2.0), ("3B", 3.0), ("7B", 7.0), ("8B", 8.0),
                ("9b", 9.0), ("9B", 9.0)]
EXCLUDED_MARKERS = ["zeroshot", "test", "augs", "debug", "batch-calibration-probs", "rank1", "default", "ensemble",
                    "sensitivity-aware-decoding", "batch-calibration", "lora", "exact-match", "compositional",
                    "cross", "unbalanced", "consistency"]
SELECTED_FAMILIES = ["Llama", "Qwen2.5", "gemma-2"]
CATALOGUE_FAMILIES = ["falcon", "gemma", "Llama", "Qwen"]
CATALOGUE_SIZES = ["1B", "1.5B", "2b", "3B", "7B", "8B", "9b"]


def average_rank(df: DataFrame, group: list[str], value: str, higher_is_better: bool = True,
                 out: str = "rank") -> DataFrame:
    """rank within group, ties get the average of their positions (pandas ``rank``)."""
    order = F.col(value).desc() if higher_is_better else F.col(value).asc()
    w = Window.partitionBy(*group).orderBy(order)
    wt = Window.partitionBy(*group, value)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(wt) - 1) / 2.0)


def pareto_front(df: DataFrame, group: list[str], maximize: str, minimize: str) -> DataFrame:
    """rows not dominated - sort by (maximize desc, minimize asc), keep strict new minima."""
    w = (Window.partitionBy(*group).orderBy(F.col(maximize).desc(), F.col(minimize).asc())
         .rowsBetween(Window.unboundedPreceding, -1))
    x = df.withColumn("__prev_min", F.min(minimize).over(w))
    return x.where(F.col("__prev_min").isNull() | (F.col(minimize) < F.col("__prev_min"))).drop("__prev_min")


def covariance_ellipse(df: DataFrame, group: list[str], x: str, y: str, n_std: float = 3.0) -> DataFrame:
    """mean vector, 2x2 sample covariance and the ellipse (axes = n_std * 2*sqrt(eigenvalue), angle).

    Eigen-decomposition in closed form; the angle is that of the eigenvector of
    the smaller eigenvalue, folded into [0, 180) so its sign is canonical.
    """
    g = df.groupBy(*group).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
                               F.var_samp(x).alias("cov_xx"), F.covar_samp(x, y).alias("cov_xy"),
                               F.var_samp(y).alias("cov_yy"))
    a, b, c = F.col("cov_xx"), F.col("cov_xy"), F.col("cov_yy")
    half = F.sqrt(((a - c) / 2) ** 2 + b * b)
    lo, hi = (a + c) / 2 - half, (a + c) / 2 + half
    # eigenvector of lo: (b, lo - a), or (1, 0) / (0, 1) when b == 0
    vx = F.when(b != 0, b).when(a <= c, F.lit(1.0)).otherwise(F.lit(0.0))
    vy = F.when(b != 0, lo - a).when(a <= c, F.lit(0.0)).otherwise(F.lit(1.0))
    ang = F.degrees(F.atan2(vy, vx))
    ang = F.when(ang < 0, ang + 180).when(ang >= 180, ang - 180).otherwise(ang)
    return g.select("*", (n_std * 2 * F.sqrt(F.greatest(lo, F.lit(0.0)))).alias("width"),
                    (n_std * 2 * F.sqrt(F.greatest(hi, F.lit(0.0)))).alias("height"), ang.alias("angle"))


def sqrt_bins_histogram(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """equal-width histogram with ceil(sqrt(n)) bins per group (max falls in the last bin)."""
    w = Window.partitionBy(*group)
    n, lo, hi = F.count(F.lit(1)).over(w), F.min(value).over(w), F.max(value).over(w)
    x = df.select(*group, value, n.alias("__n"), lo.alias("__lo"), hi.alias("__hi"))
    bins = F.ceil(F.sqrt(F.col("__n")))
    pos = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins))
    x = x.withColumn("bin", F.least(pos, bins - 1).cast("int")).withColumn("n_bins", bins.cast("int"))
    return x.groupBy(*group, "n_bins", "bin").agg(F.count(F.lit(1)).alias("n"))


def method_order_index(method: Column) -> Column:
    """position in the fixed method order (unknown methods last)."""
    pos = F.array_position(F.array(*[F.lit(m) for m in METHOD_ORDER]), method)
    return F.when(pos == 0, F.lit(len(METHOD_ORDER) + 1)).otherwise(pos)


def model_size(name: Column) -> Column:
    """first size marker contained in the model name (the reference's if/elif order)."""
    out = F.lit(None).cast("double")
    for marker, size in reversed(SIZE_MARKERS):
        out = F.when(name.contains(marker), F.lit(size)).otherwise(out)
    return out


def normalized_entropy(df: DataFrame, group: list[str], cls: str) -> DataFrame:
    """F32: class counts and -sum(p ln p)/ln(k) per group; k = 1 gives NULL."""
    counts = df.groupBy(*group, cls).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(w))
    return p.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n_rows"),
        F.when(F.count(F.lit(1)) > 1, -F.sum(F.col("p") * F.log("p")) / F.log(F.count(F.lit(1)).cast("double")))
        .alias("normalized_entropy"))


def py_title(s: Column) -> Column:
    """Python ``str.title``: a letter after a non-letter is upper-cased, other letters lower-cased.

    (``initcap`` only looks at spaces: '1b' stays '1b' where Python gives '1B'.)
    """
    chars = F.split(s, "")
    letter = "\\p{L}"
    out = F.transform(chars, lambda c, i: F.when(
        (i == 0) | ~F.element_at(chars, F.greatest(i, F.lit(1))).rlike(letter), F.upper(c)).otherwise(F.lower(c)))
    return F.array_join(out, "")


# Fixed values (must equal the reference): experiment-name rewrites, applied in this order.
LORA_TAIL_REWRITES = [("0-shot", ""), ("response-only-", ""), ("iidx2-consistency-", " (consistency)"), ("iidx2-", ""),
                      ("cross-", " (cross-domain)"), ("iid-", " (cross-domain)"), ("separator-space-", ""),
                      ("compositional-", " (compositional)"), ("May--beta-50", " (May, beta=50)"), ("May-", " (May)"),
                      ("32augs-", " (32 augs)"), ("2augs-", " (2 augs)"), ("8augs-", " (8 augs)"),
                      ("16augs-", " (16 augs)")]
ICL_TAIL_REWRITES = [("2-shot", ""), ("iidx2-split-", ""), ("iidx2-", ""), ("iid-", "(new) "),
                     ("batch-calibration-", "BC"), ("sensitivity-aware-decoding-", "SAD"), ("template-ensembles-", "TE")]
COMMON_TAIL_REWRITES = [("no-chat-template-", ""), ("unbalanced-", ""), ("exact-match-", "")]
MODEL_REWRITES = [("-Instruct", ""), ("-it", ""), ("Meta-", ""), ("2.5", " 2.5"), ("-", " ")]
SETTING_MARKERS = [("exact-match", "exact-match"), ("unbalanced", "unbalanced"), ("cross", "cross-domain"),
                   ("compositional", "compositional")]


def rewrite(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def experiment_keep(name: Column) -> Column:
    """the reference's experiment filters (exclusions, template, shots x LoRA, instruct, family)."""
    keep = F.lit(True)
    for m in EXCLUDED_MARKERS:
        keep = keep & ~name.contains(m)
    keep = keep & name.contains("no-chat-template")
    keep = keep & ((name.contains("2-shot") & ~name.contains("lora")) | (name.contains("0-shot") & name.contains("lora")))
    keep = keep & (F.lower(name).contains("instruct") | name.contains("it"))
    fam = F.lit(False)
    for f in SELECTED_FAMILIES:
        fam = fam | name.contains(f)
    return keep & fam


def parse_experiment(name: Column) -> dict[str, Column]:
    """model display name, method handle, setting and size from ``Model---tail``."""
    model = F.split(name, "---").getItem(0)
    tail = F.split(name, "---").getItem(1)
    setting = F.lit("uniform")
    for marker, value in reversed(SETTING_MARKERS):
        setting = F.when(tail.contains(marker), F.lit(value)).otherwise(setting)
    t = rewrite(tail, COMMON_TAIL_REWRITES)
    lora = model.contains("lora")
    lora_tail = F.concat(F.lit("LoRA"), rewrite(t, LORA_TAIL_REWRITES))
    icl = rewrite(t, ICL_TAIL_REWRITES)
    icl = F.when(icl.isin("", "-"), F.lit("FS")).otherwise(icl)
    method = F.when(lora, lora_tail).otherwise(icl)
    base = F.when(lora, F.replace(model, F.lit("_lora"), F.lit(""))).otherwise(model)
    display = py_title(rewrite(base, MODEL_REWRITES))
    return {"model": display, "method": method, "setting": setting, "size": model_size(display)}
