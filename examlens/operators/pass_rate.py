"""Pass rates and the hardest exams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from .model import Model


def exam_pass_rate(model: Model) -> DataFrame:
    """Enrolled, passed and percentage passed per exam, calendar year and program."""
    return rates_of(
        model,
        model.totals(
            [*model.keys("program", "exam"), "year"],
            n_passed=F.when(F.col("passed") == 1, 1).otherwise(0),
            n_enrolled=F.lit(1),
        ),
    )


def rates_of(model: Model, counts: DataFrame) -> DataFrame:
    """The rates from `n_passed` and `n_enrolled` per exam, year and program."""
    return model.label(counts, "program", "exam").select(
        "program_code",
        "program",
        "year",
        "exam_code",
        "exam",
        "n_enrolled",
        "n_passed",
        (F.col("n_passed").cast("double") * 100.0 / F.col("n_enrolled")).alias("ratio"),
    )


def hardest_exams(model: Model, k: int = 10) -> DataFrame:
    return hardest_of(exam_pass_rate(model), k)


def hardest_exams_overall(model: Model, k: int = 10) -> DataFrame:
    """The k exams with the lowest pass rate of each program and year; equal ones by exam code.

    The question as asked, beside `hardest_exams`. The year is the calendar year of the
    sessions; rows without codes name no exam.
    """
    rates = exam_pass_rate(model)
    rates = rates.filter(F.col("program_code").isNotNull() & F.col("exam_code").isNotNull())
    return top_k(rates, ["program_code", "year"], [F.col("ratio"), F.col("exam_code")], k)


def hardest_exams_by_academic_year(model: Model, k: int = 10, first_month: int = 10) -> DataFrame:
    """The k exams with the lowest pass rate of each program and academic year; equal ones by exam code.

    The question as asked, beside `hardest_exams`: all sessions of an academic year count
    together. It begins in `first_month` and is called by both of its calendar years;
    sessions without a valid date are in none.
    """
    keys = model.keys("program", "exam")
    sums = model.totals(
        [*keys, "session_date"], n_passed=F.when(F.col("passed") == 1, 1).otherwise(0), n_enrolled=F.lit(1)
    )
    begins = F.year("_day") - F.when(F.month("_day") < first_month, 1).otherwise(0)
    years = sums.withColumn("_day", model.date()).where("_day is not null")
    years = years.withColumn("year", F.concat_ws("/", begins, begins + 1))
    counts = years.groupBy(*keys, "year").agg(F.sum("n_passed").alias("n_passed"), F.sum("n_enrolled").alias("n_enrolled"))
    rates = rates_of(model, counts).dropna(subset=["program_code", "exam_code"])
    hardest = top_k(rates, ["program_code", "year"], [F.col("ratio"), F.col("exam_code")], k)
    return hardest.withColumnRenamed("year", "academic_year")


def hardest_of(rates: DataFrame, k: int = 10) -> DataFrame:
    """All years of the exams found in a program's first k rows by (year, ratio).

    The years come first in that order, so the earliest year decides which exams
    are chosen, and more than k rows per program come back. This is intended. Rows
    without codes name no exam; dropping them here rather than in the join also lets
    both uses of `rates` share one shuffle.
    """
    rates = rates.filter(F.col("program_code").isNotNull() & F.col("exam_code").isNotNull())
    first = top_k(rates, ["program_code"], [F.col("year"), F.col("ratio"), F.col("exam_code")], k)
    chosen = first.select("program_code", "exam_code").distinct()
    return rates.join(chosen, ["program_code", "exam_code"], "left_semi").select(*rates.columns)
