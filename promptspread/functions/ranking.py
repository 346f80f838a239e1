"""Ranking helpers that stay safe when one group holds a large share of rows.

A plain ``row_number() over (partition by g order by k)`` sends every row of a
group to one task.  When a coarse *monotone* bucket of ``k`` is available (a
digest prefix, a time bucket), the group can be cut into buckets: count rows
per (group, bucket) - a small partial-aggregated table - turn the counts into
running offsets, and number rows inside each bucket only.  The join on
(group, bucket) and the per-bucket window share one hash partitioning, so the
plan shuffles the wide rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(seed, *cols) -> Column:
    """md5('seed|c1|c2...') - the portable random order (same digest in DuckDB)."""
    parts = [F.lit(str(seed))] + [c.cast("string") if isinstance(c, Column) else F.col(c).cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def bucketed_rank(df: DataFrame, group_cols: list[str], order_cols: list, bucket: Column,
                  out_col: str = "rn") -> DataFrame:
    """Add 1-based ``out_col`` = ``row_number() over (partition by group order by order_cols)``.

    ``bucket`` must be non-decreasing in ``order_cols`` (e.g. a digest prefix
    for a digest order, an hour for a timestamp order).
    """
    b = "__bucket"
    keyed = df.withColumn(b, bucket)
    counts = keyed.groupBy(*group_cols, b).agg(F.count(F.lit(1)).alias("__n"))
    w_off = (Window.partitionBy(*group_cols).orderBy(b)
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*group_cols, b, F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__off"))
    w_in = Window.partitionBy(*group_cols, b).orderBy(*order_cols)
    return (keyed.join(offsets, [*group_cols, b])
            .withColumn(out_col, (F.col("__off") + F.row_number().over(w_in)).cast("bigint"))
            .drop(b, "__off"))


def hashed_rank(df: DataFrame, group_cols: list[str], key_col: str, out_col: str = "rn",
                prefix_chars: int = 4, tiebreak: list[str] | None = None) -> DataFrame:
    """Rank by a hex digest column; buckets are the first ``prefix_chars`` hex digits."""
    return bucketed_rank(df, group_cols, [key_col, *(tiebreak or [])],
                         F.substring(F.col(key_col), 1, prefix_chars), out_col)


def running_sums(df: DataFrame, group_cols: list[str], order_col: str, sums: dict[str, str], block: int = 1024) -> DataFrame:
    """Add ``out = sum(column)`` over all rows of a group up to and including each row, for ``sums`` {out: column}.

    ``order_col`` is a whole number, distinct within a group.  A group is cut into
    blocks of ``block`` numbers: blocks are summed (a partial aggregate), the sums of
    earlier blocks are added to the running sums inside each block.  So a group may
    hold any share of the rows; what one task sees of it is one block, or one row
    for each block.
    """
    b = "__block"
    keyed = df.withColumn(b, F.floor(F.col(order_col) / block))
    per = keyed.groupBy(*group_cols, b).agg(*[F.sum(c).alias(f"__{out}") for out, c in sums.items()])
    before = Window.partitionBy(*group_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*group_cols, b, *[F.coalesce(F.sum(f"__{out}").over(before), F.lit(0)).alias(f"__{out}") for out in sums])
    inside = Window.partitionBy(*group_cols, b).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(offsets, [*group_cols, b]).select(
        *df.columns, *[(F.col(f"__{out}") + F.sum(c).over(inside)).alias(out) for out, c in sums.items()])
