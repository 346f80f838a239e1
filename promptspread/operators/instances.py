"""Instance preparation (B1-B17, A3, A4): permutations, splits, field extraction.

Ordering within a task uses digest keys (portable across engines) and the
bucketed rank helper, so a task holding a large share of the rows is still
numbered by many tasks.  Caps (``row_number <= n``) let Spark push a partial
group limit below the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptspread.functions.ranking import hashed_rank, seeded_key

# Fixed value (must equal the reference): characters a template hole may match.
# A Java/RE2 character-class body; note the range from the apostrophe to the en dash.
FIELD_CHARS = ("A-Za-z0-9α-ωΑ-Ω“”‘’′`,.…'-–—−:∶()\\[\\]{}/%?!\" ;$≤≥≠†€₹→≡~∨⊃·°•∃∀ʻ&⁄_#\\n"
               "𝑆𝑚√𝑠𝑁𝐴𝑒𝑅𝑇ι⟩⟨›‹ου‖♥‰�龍►➥™,‚∼⋅")
FIELD_CLASS = f"[{FIELD_CHARS}]"
HOLE = "{}"
N_DEMOS = 10   # the first 10 permuted rows are the demonstration pool


def seeded_shuffle(df: DataFrame, group: list[str], id_col: str, seed: int, out: str = "ord") -> DataFrame:
    """B1 (shuffle): 0-based position in the md5(seed|id) order within ``group``."""
    keyed = df.withColumn("__k", seeded_key(seed, F.col(id_col)))
    return (hashed_rank(keyed, group, "__k", out_col="__rn")
            .withColumn(out, (F.col("__rn") - 1).cast("bigint")).drop("__k", "__rn"))


def apply_permutation(df: DataFrame, perm: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """B1 (stored): attach ``ord`` from a long permutation table (keys, ord, id) - an equi-join."""
    return df.join(perm.select(*keys, id_col, "ord"), [*keys, id_col])


def demo_eval_split(ord_col: Column, n_demos: int = N_DEMOS) -> Column:
    """B2: the first ``n_demos`` permuted rows are demonstrations, the rest evaluation rows."""
    return F.when(ord_col < n_demos, F.lit("demo")).otherwise(F.lit("eval"))


def template_regex(template: Column) -> Column:
    """Template with ``{}`` holes -> anchored regex; literals quoted, holes -> field class."""
    parts = F.split(template, "\\{\\}", -1)
    quoted = F.transform(parts, lambda p: F.when(p == "", p).otherwise(F.concat(F.lit("\\Q"), p, F.lit("\\E"))))
    return F.concat(F.lit("^"), F.array_join(quoted, f"({FIELD_CLASS}+)"), F.lit("$"))


def regex_literal(template: str) -> str:
    """Python-side twin of ``template_regex`` for literal templates known at plan time."""
    parts = template.split(HOLE)
    quoted = [p if p == "" else f"\\Q{p}\\E" for p in parts]
    return "^" + f"({FIELD_CLASS}+)".join(quoted) + "$"


def first_n_per_group(df: DataFrame, group: list[str], order: list[str], n: int, out: str = "rn") -> DataFrame:
    """The first ``n`` rows per group in ``order`` (window group limit, map-side partial)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def choose_instruction(df: DataFrame, group: list[str], text_col: str, order_col: str) -> DataFrame:
    """A3: longest candidate that starts upper-case; the first one wins ties (hash aggregate)."""
    upper = F.col(text_col).rlike("^[\\p{Lu}\\x{2160}-\\x{216F}\\x{24B6}-\\x{24CF}]")
    best = F.max(F.struct(F.length(text_col).alias("len"), (-F.col(order_col)).alias("no"),
                          F.col(order_col).alias("id")))
    return (df.where(upper).groupBy(*group).agg(best.alias("__b"))
            .select(*group, F.col("__b.id").alias("instruction_id"), F.col("__b.len").alias("instruction_length")))


def shuffle_options(df: DataFrame, keys: list[str], options_col: str, correct_col: str, seed: int) -> DataFrame:
    """Seeded shuffle of answer options per row; 0-based index of the correct one.

    Options are few per row: array functions, no explode/shuffle.
    """
    key = lambda o: F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], o))
    ordered = F.transform(
        F.array_sort(F.transform(F.col(options_col), lambda o: F.struct(key(o).alias("k"), o.alias("o")))),
        lambda s: s["o"])
    return (df.withColumn("shuffled", ordered)
              .withColumn("correct_idx", (F.array_position(F.col("shuffled"), F.col(correct_col)) - 1).cast("int")))
