"""Statistical column helpers shared by the metric operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column: engines differ in the last bit of sums."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def ratio(num: Column, den: Column) -> Column:
    """num / max(den, 1) as double (the reference's accuracy denominator)."""
    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")


def with_position(df: DataFrame, group_cols: list[str], value_col: str,
                  rn_col: str = "__rn", cnt_col: str = "__cnt") -> DataFrame:
    """Rank rows by ``value_col`` within the group and attach the group size.

    Meant for already-aggregated rows (one per format), never raw rows.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.col(value_col).asc())
    wc = Window.partitionBy(*group_cols)
    return (df.withColumn(rn_col, F.row_number().over(w))
              .withColumn(cnt_col, F.count(F.lit(1)).over(wc)))


def exclusive_quartile(i: int, value_col: str, rn_col: str = "__rn", cnt_col: str = "__cnt") -> Column:
    """Aggregate expression for the i-th exclusive quartile (Python ``statistics.quantiles``).

    Position ``i(n+1)/4`` interpolated between neighbours, clamped to the first
    and last pair; NULL for fewer than two values.  Needs ``with_position`` rows.
    """
    n = F.col(cnt_col)
    j = F.least(F.greatest(F.floor(F.lit(i) * (n + 1) / 4), F.lit(1)), n - 1)
    delta = F.lit(i) * (n + 1) - j * 4
    x = F.col(value_col)
    lo = F.max(F.when(F.col(rn_col) == j, x * (4 - delta)))
    hi = F.max(F.when(F.col(rn_col) == j + 1, x * delta))
    return F.when(F.max(n) >= 2, (lo + hi) / 4)
