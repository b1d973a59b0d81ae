"""Exams that take the most attempts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Model


def mean_attempts(model: Model) -> DataFrame:
    """Mean failed enrolments per exam over the students who failed it at all.

    An exam of several programs is shown with the first program label.
    """
    keys = model.keys("exam", "program")
    failed = model.rows().filter(F.col("passed") == 0)
    return attempts_of(model, failed.groupBy("student_id", *keys).agg(F.count(F.lit(1)).alias("_failed")))


def attempts_of(model: Model, per_student: DataFrame) -> DataFrame:
    """The means from `_failed` per student, exam and program."""
    keys = model.keys("exam", "program")
    per_program = per_student.groupBy(*keys).agg(
        F.sum("_failed").alias("_failed"), F.count(F.lit(1)).alias("_students")
    )
    return (
        model.label(per_program, "exam", "program")
        .groupBy("exam_code", "exam")
        .agg(
            F.min("program").alias("program"),
            (F.sum("_failed").cast("double") / F.sum("_students")).alias("attempts"),
        )
    )


def trial_and_error_by_program(model: Model) -> DataFrame:
    """Mean failed enrolments per program over its students' exams, those never failed included.

    The question as asked, beside `trial_and_error`.
    """
    keys = model.keys("program")
    failed = F.sum(F.when(F.col("passed") == 0, 1).otherwise(0))
    per_exam = model.rows().groupBy("student_id", "exam_code", *keys).agg(failed.alias("_failed"))
    per_program = per_exam.groupBy(*keys).agg(F.avg("_failed").alias("attempts"))
    return model.label(per_program, "program").select("program_code", "program", "attempts")


def trial_and_error(model: Model, k: int = 3) -> DataFrame:
    """The k exams with the most attempts; equal ones by exam code."""
    return most_attempts(mean_attempts(model), k)


def most_attempts(means: DataFrame, k: int = 3) -> DataFrame:
    return means.orderBy(F.desc("attempts"), F.asc("exam_code")).limit(k)
