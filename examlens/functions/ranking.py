"""Top-k per group and lower median."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group.

    Catalyst turns the rank filter into a WindowGroupLimit on both sides of the
    shuffle, so each task sends at most k rows per group, however large a group is.
    `order` must be total within a group, otherwise the cut is not repeatable.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def upper_half(df: DataFrame, count: str, *maxima: str) -> DataFrame:
    """The values of `count` in `df` from its lower median upwards, one row each.

    Every row also holds, over all rows of `df` with these values, `lower_median`
    and `max_<column>` for the count and the columns of `maxima`.

    Works on the histogram of the counts. That has one row per *different* count;
    d different counts of enrolments need at least d*(d+1)/2 enrolments, so 10^12
    enrolments give fewer than 1.5 million short rows. This bound allows the windows
    over all rows here, and a broadcast of the result.
    """
    histogram = df.groupBy(count).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.max(c).alias(f"_max_{c}") for c in maxima]
    )
    everything = Window.partitionBy()
    running = everything.orderBy(count).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        histogram.withColumn("_until", F.sum("_rows").over(running))
        .withColumn("_all", F.sum("_rows").over(everything))
        .filter(F.col("_until") * 2 >= F.col("_all"))
        .select(
            count,
            F.min(count).over(everything).alias("lower_median"),
            F.max(count).over(everything).alias(f"max_{count}"),
            *[F.max(f"_max_{c}").over(everything).alias(f"max_{c}") for c in maxima],
        )
    )
