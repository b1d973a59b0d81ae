"""One pass over the enrolments for all questions.

Every question starts from sums at one of three grains: student and program, session
date of an exam, and failures of a student in an exam. Grouping sets answer the three
from a single scan and shuffle; the summary is one table with a `grain` column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Model, StarModel

STUDENTS, SESSIONS, FAILURES = "students", "sessions", "failures"


def _rows(model: Model) -> DataFrame:
    """Enrolments with their keys; `listed_grade` is NULL for exams that the exam table lacks."""
    rows = model.rows()
    if not isinstance(model, StarModel):
        return rows.withColumn("listed_grade", F.col("grade"))
    listed = model.exam.select("exam_code").distinct().withColumn("_listed", F.lit(True))
    sessions = model.session.withColumn("session_day", model.date()).join(listed, "exam_code", "left")
    rows = model.enrolment.join(sessions, "session_id")
    return rows.withColumn("listed_grade", F.when(F.col("_listed"), F.col("grade")))


def summarise(model: Model) -> DataFrame:
    """The summary: keys of the three grains, `grain`, and the sums each grain needs.

    A task sends one row per group and grain, so a hot session, exam or program is
    combined before the shuffle; students without a failure in an exam have no row there.
    Their enrolments are not grouped by student at that grain: they carry no failed
    student and meet in one group an exam, which adds no failure to anybody. Of that
    grain `n_failed` alone is told.
    """
    program, exam = model.keys("program"), model.keys("exam")
    sets = {
        STUDENTS: ["student_id", *program],
        SESSIONS: [*program, *exam, "session_date"],
        FAILURES: ["_failed_student", *program, *exam],
    }
    columns = list(dict.fromkeys(c for keys in sets.values() for c in keys))
    passed = F.col("passed") == 1
    graded = F.when(passed, F.col("grade"))
    grouped = (
        _rows(model)
        .withColumn("_failed_student", F.when(F.col("passed") == 0, F.col("student_id")))
        .groupingSets([[F.col(c) for c in keys] for keys in sets.values()], *columns)
        .agg(
            F.grouping_id(*columns).alias("_id"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(passed, 1).otherwise(0)).alias("n_passed"),
            F.sum(F.when(F.col("passed") == 0, 1).otherwise(0)).alias("n_failed"),
            F.sum("grade").alias("grades"),
            F.count("grade").alias("n_grades"),
            F.sum("listed_grade").alias("listed_grades"),
            F.count("listed_grade").alias("n_listed"),
            F.sum(graded).alias("passed_grades"),
            F.count(graded).alias("n_passed_grades"),
            F.min("session_day").alias("min_date"),
            F.max("session_day").alias("max_date"),
        )
    )
    # The grouping id has a bit for every column that a set leaves out.
    number = {
        grain: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)
        for grain, keys in sets.items()
    }
    grain = F.coalesce(*[F.when(F.col("_id") == n, grain) for grain, n in number.items()])
    kept = (F.col("grain") != FAILURES) | (F.col("n_failed") > 0)
    grouped = grouped.withColumn("grain", grain).where(kept)
    student = F.when(F.col("grain") == FAILURES, F.col("_failed_student")).otherwise(F.col("student_id"))
    return grouped.withColumn("student_id", student).drop("_id", "_failed_student")
