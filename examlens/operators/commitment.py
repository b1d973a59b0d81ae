"""Exams of one program on the same day."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dashboard import filter_programs
from .model import Model


def _daily(model: Model) -> DataFrame:
    keys = model.keys("program")
    return model.offered().groupBy("session_date", *keys).agg(F.countDistinct("exam_code").alias("n_exams"))


def same_day_load(model: Model) -> DataFrame:
    """Different exams per program and date."""
    return model.label(_daily(model), "program").select("program", "session_date", "n_exams")


def commitment_rate(model: Model) -> DataFrame:
    """Share of a program's exams held on a day with another exam of the program.

    `sum_commit` and the rate are NULL for programs without such a day.
    """
    return rates_of(model, _daily(model))


def rates_of(model: Model, daily: DataFrame) -> DataFrame:
    """The rates from `n_exams` per program and date."""
    shared = F.when(F.col("n_exams") > 1, F.col("n_exams"))
    sums = (
        daily.groupBy(*model.keys("program"))
        .agg(F.sum(shared).alias("sum_commit"), F.sum("n_exams").alias("sum_all"))
    )
    return model.label(sums, "program").select(
        "program",
        "sum_commit",
        "sum_all",
        (F.col("sum_commit").cast("double") / F.col("sum_all")).alias("commit_rate"),
    )


def commitment_top_n(rates: DataFrame, programs: list[str], cap: int = 10) -> DataFrame:
    """The selected programs with the highest rates, at most `cap` of them."""
    return (
        filter_programs(rates, programs)
        .orderBy(F.desc_nulls_last("commit_rate"), "program")
        .limit(min(cap, len(programs)))
    )
