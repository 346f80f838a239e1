"""Operator 7, mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Targets: the sources, in code point order with null last, take the given weights
in turn and share ``percent`` % of all sizes; a target stops at ``epochs`` times
its source's size and what is above is shared again by weight.  That settles at
one level ``l`` with target = min(weight * l, cap), which a running sum over the
sources sorted by cap / weight yields.

Selection: a source first gives its complete epochs.  For the rest, every
document draws an exponential key ``-ln(u) / quality weight`` from a hash of its
id; in key order, the documents whose running size still fits are taken.  Further
rounds do the same among the documents left that fit into what is still missing,
until none fits: a source ends less than its smallest document left below its
target.  Each round looks at the remaining candidates only; what is missing is
smaller than the document that ended the round before.

The running sums are distributed: keys map to ranges in (0, 1), ranges are summed
per source, and a range's rows are numbered on their own, so a source holding
most rows is as parallel as any.  Only (id, source, size, key) rows are shuffled.
What is known per source is broadcast up to ``SOURCES`` sources, beyond that joined.

Defined results: a null source is a source of its own; null and empty texts have
size 0 and take 0 words; null, zero and negative quality weights count as 1.
Rows equal in id, text and source are taken together.  Ties of keys go to the
smaller id, then text hash.  Very long texts count like any other; columns beside
the three named ones are ignored by ``mix`` and kept by ``repeated``, whatever
their names.  An empty table mixes to an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptspread.llm.common import WORD_PATTERN, fresh_path, parallelism, stored, unused

SOURCES = 100_000    # sources whose facts are broadcast
RANGE_ROWS = 20_000  # about so many rows share a range


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def exponential_key(id_: Column, weight: Column, seed: int) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from 52 bits of a hash of the id."""
    digits = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digits, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / F.when(weight > 0, weight.cast("double")).otherwise(1.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, epochs: int = 2) -> DataFrame:
    """(no_source, source, source_size, target) from one row per source: (no_source, source, source_size)."""
    order = Window.orderBy("no_source", "source")
    n = F.row_number().over(order) - 1
    ranked = sizes.select("*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int")).alias("w"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = ranked.select("*", (F.col("source_size") * epochs).cast("double").alias("cap"),
                           (F.sum("source_size").over(everything) * (percent / 100)).alias("budget"), F.sum("w").over(everything).alias("all_w"))
    before = Window.orderBy(F.col("cap") / F.col("w"), "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), zero)) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), zero))
    levels = capped.select("*", level.alias("l"))
    return levels.select("no_source", "source", "source_size", F.least("cap", F.col("w") * F.max("l").over(everything)).alias("target"))


def _fits(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows plus ``before_and_own``: the running size, in key order within the source, of the rows that are still candidates."""
    keys = ["no_source", "source", "r"]
    dealt = rows.withColumn("r", F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), F.lit(ranges - 1)).cast("int"))
    counted = F.when(F.col("candidate"), F.col("unit")).otherwise(F.lit(0))
    sums = dealt.groupBy(*keys).agg(F.sum(counted).alias("s"))
    earlier = Window.partitionBy("no_source", "source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy(*keys).orderBy("key", "id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(offsets, keys).withColumn("running", F.col("offset") + F.sum(counted).over(within)).drop("r", "offset")


def mix(df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", quality: DataFrame | None = None,
        weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, epochs: int = 2, seed: int = 23) -> DataFrame:
    """One row per distinct (id, text, source): (id, h, source, copies, size, source_size, target, times).

    ``times`` is how often the mix takes the document, ``h`` a hash of its text;
    ``quality`` has (id, weight), the largest weight of an id counting.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{source}`").isNull().alias("no_source"),
                     F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:  # joined to sizes, not to texts
        best = quality.groupBy(F.col("id").alias("q")).agg(F.max("weight").alias("weight"))
        rows = rows.join(best, F.col("id") == F.col("q"), "left").drop("q")
    rows = rows.withColumn("key", exponential_key(F.col("id"), F.col("weight"), seed)).drop("weight")
    units = stored(rows.groupBy("id", "h", "no_source", "source").agg(
        F.count("*").alias("copies"), F.max("size").alias("size"), F.min("key").alias("key")), "mix_units")
    ranges = max(64, 4 * parallelism(spark), math.ceil(units.count() / RANGE_ROWS))
    unit = F.col("size") * F.col("copies")
    per_source = stored(units.groupBy("no_source", "source").agg(F.sum(unit).alias("source_size")), "mix_sources")
    few = per_source.count() <= SOURCES
    small = lambda facts: F.broadcast(facts) if few else facts
    keys, who = ["no_source", "source"], ["id", "h", "no_source", "source"]
    whole = F.floor(F.col("target") + 1e-6)
    done = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0))
    goal = stored(targets(per_source, weights, percent, epochs).select(*keys, "source_size", "target", done.alias("complete"), (whole - done * F.col("source_size")).cast("long").alias("missing")), "mix_goal")
    left, missing, folder, round_ = units.select(*who, unit.alias("unit"), "key"), goal.select(*keys, "missing"), fresh_path(spark, "mix_chosen"), 0
    while True:
        fits = (F.col("unit") <= F.col("missing")) & (F.col("missing") > 0)
        candidates = left.join(small(missing), keys).where(fits).withColumn("candidate", F.lit(True))
        fitted = stored(_fits(candidates, ranges).select(*who, "unit", "key", (F.col("running") <= F.col("missing")).alias("now")), f"mix_round_{round_}")
        if round_ and fitted.isEmpty():
            break
        fitted.where("now").select(*who).write.parquet(f"{folder}/round={round_}")
        given = fitted.where("now").groupBy(*keys).agg(F.sum("unit").alias("given"))
        missing = stored(missing.join(given, keys, "left").select(*keys, (F.col("missing") - F.coalesce("given", F.lit(0))).alias("missing")), f"mix_missing_{round_}")
        # a document too large now is too large for good; one that was taken is done
        left, round_ = fitted.where("NOT now").drop("now"), round_ + 1
    chosen = spark.read.schema(units.select(*who).schema).parquet(folder).select(*[F.col(c).alias(f"c_{c}") for c in who], F.lit(1).alias("chosen"))
    same = units["id"].eqNullSafe(chosen["c_id"]) & (units["h"] == chosen["c_h"]) & (units["no_source"] == chosen["c_no_source"]) & (units["source"] == chosen["c_source"])
    out = units.join(chosen, same, "left").join(small(goal.drop("missing")), keys)
    times = (F.col("complete") + F.coalesce("chosen", F.lit(0))).cast("int")
    return out.select("id", "h", F.when(~F.col("no_source"), F.col("source")).alias("source"), "copies", "size", "source_size", "target", times.alias("times"))


def repeated(df: DataFrame, plan: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of ``df`` as often as ``plan`` takes it."""
    i, h, s, times, copy = (unused(df.columns, name) for name in ("p_id", "p_h", "p_source", "p_times", "p_copy"))
    p = plan.where("times > 0").select(F.col("id").alias(i), F.col("h").alias(h), F.col("source").alias(s), F.col("times").alias(times))
    on = df[id_].eqNullSafe(p[i]) & (F.xxhash64(df[text]) == p[h]) & df[source].eqNullSafe(p[s])
    return df.join(p, on).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in df.columns])
