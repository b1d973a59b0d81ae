"""Mean grades and the best and worst exams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from .model import Model


def exam_mean_grade(model: Model) -> DataFrame:
    """Mean grade per program and exam over passed, graded enrolments.

    The wide model keeps exams that were passed without any grade, with a NULL mean.
    """
    where = F.col("passed") == 1
    if not model.keeps_ungraded_exams:
        where = where & F.col("grade").isNotNull()
    sums = model.totals(
        model.keys("program", "exam"),
        where=where,
        _grades=F.col("grade"),
        _n=F.col("grade").isNotNull().cast("int"),
    )
    return means_of(model, sums)


def means_of(model: Model, sums: DataFrame) -> DataFrame:
    """The means from `_grades` and `_n` per program and exam."""
    return model.label(sums, "program", "exam").select(
        "program_code",
        "program",
        "exam_code",
        "exam",
        F.try_divide(F.col("_grades").cast("double"), F.col("_n")).alias("mean_grade"),
    )


def _ranked(means: DataFrame) -> DataFrame:
    """Means that can be placed: there is one, and program and exam are known."""
    return means.dropna(subset=["program_code", "exam_code", "mean_grade"])


def best_exams(model: Model, k: int = 3) -> DataFrame:
    """Exams with the highest means per program; equal means by exam code."""
    return best_of(exam_mean_grade(model), k)


def best_of(means: DataFrame, k: int = 3) -> DataFrame:
    return top_k(_ranked(means), ["program_code"], [F.desc("mean_grade"), F.asc("exam_code")], k)


def worst_exams(model: Model, k: int = 3) -> DataFrame:
    """Exams with the lowest means per program; equal means by exam code."""
    return worst_of(exam_mean_grade(model), k)


def worst_of(means: DataFrame, k: int = 3) -> DataFrame:
    return top_k(_ranked(means), ["program_code"], [F.asc("mean_grade"), F.asc("exam_code")], k)
