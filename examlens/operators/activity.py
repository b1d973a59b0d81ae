"""Active students and their weighted score.

The one expensive step, grouping enrolments by (student, program), feeds both the
median with the maxima and the rows themselves. Both sides are written over the same
aggregate with the same columns, so Spark runs the grouping once and reuses its
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_between
from ..functions.ranking import upper_half
from .model import Model

ACTIVITY = ["program", "program_code", "student_id", "n_exams"]
PROFILE = [
    "program_code",
    "program",
    "student_id",
    "avg_grade",
    "n_exams",
    "max_date",
    "min_date",
    "diff_day",
]
MAXIMA = ["diff_day", "avg_grade"]


def student_activity(model: Model) -> DataFrame:
    """Enrolments per student and program."""
    return activity_of(model, model.per_student(lambda m: m.rows(), F.count(F.lit(1)).alias("n_exams")))


def activity_of(model: Model, pairs: DataFrame) -> DataFrame:
    return model.label(pairs, "program").select(*ACTIVITY)


def _in_upper_half(pairs: DataFrame, *maxima: str) -> DataFrame:
    """Pairs with a count from the lower median upwards, with the bounds as columns.

    `upper_half` proves the size of the broadcast side. It has to be broadcast: the
    pairs gather in a few small counts, a shuffle by count would be one of hot keys.
    """
    return pairs.join(F.broadcast(upper_half(pairs, "n_exams", *maxima)), "n_exams")


def active_students(model: Model) -> DataFrame:
    """Students with at least as many enrolments as the lower median of all pairs."""
    return _in_upper_half(student_activity(model)).select(*ACTIVITY)


def lower_median(model: Model) -> DataFrame:
    """The threshold of `active_students`, one row."""
    return upper_half(student_activity(model), "n_exams").agg(F.min("n_exams").alias("lower_median"))


def _all_profiles(model: Model) -> DataFrame:
    pairs = model.per_student(
        lambda m: m.graded_rows(),
        F.avg("grade").alias("avg_grade"),
        F.count(F.lit(1)).alias("n_exams"),
        F.max("session_day").alias("max_date"),
        F.min("session_day").alias("min_date"),
    )
    return profiles_of(model, pairs)


def profiles_of(model: Model, pairs: DataFrame) -> DataFrame:
    """Profiles of all pairs from their mean grade, count and first and last date."""
    if model.ungraded_mean is not None:
        pairs = pairs.withColumn("avg_grade", F.coalesce("avg_grade", F.lit(model.ungraded_mean)))
    dated = pairs.withColumn("diff_day", days_between(F.col("max_date"), F.col("min_date")))
    return model.label(dated, "program").select(*PROFILE)


def _active_profiles(model: Model) -> DataFrame:
    return active_of(_all_profiles(model))


def active_of(profiles: DataFrame) -> DataFrame:
    """Profiles of active students with the bounds as columns.

    The filter is true for every row. Without it Spark would drop unused measures
    from the side of the bounds and scan the enrolments once more for that side.
    """
    active = _in_upper_half(profiles, *MAXIMA)
    within = [F.coalesce(F.col(c) <= F.col(f"max_{c}"), F.lit(True)) for c in MAXIMA]
    return active.filter(within[0] & within[1])


def activity_profile(model: Model) -> DataFrame:
    """Mean grade, enrolments and period of activity of each active student."""
    return _active_profiles(model).select(*PROFILE)


def fast_furious(model: Model) -> DataFrame:
    return weighted_fast_furious(model, 0.5)


def weighted_fast_furious(model: Model, grade_weight: float) -> DataFrame:
    """Profiles scored by grade, and by speed times number of enrolments.

    Each measure is divided by its largest value; one that is 0 for everybody
    gives NULL.
    """
    _check_weight(grade_weight)
    return _scored(_active_profiles(model), grade_weight, *[F.col(f"max_{c}") for c in (*MAXIMA, "n_exams")])


def score_profiles(profiles: DataFrame, grade_weight: float = 0.5) -> DataFrame:
    """`weighted_fast_furious` from a table of the active students' profiles.

    The three largest values are scalar subqueries, which Catalyst answers with one
    aggregate over the table.
    """
    _check_weight(grade_weight)
    return _scored(profiles, grade_weight, *[profiles.select(F.max(c)).scalar() for c in (*MAXIMA, "n_exams")])


def _check_weight(grade_weight: float) -> None:
    if not 0 <= grade_weight <= 1:
        raise ValueError("grade_weight must be between 0 and 1")


def _scored(profiles: DataFrame, grade_weight: float, days: Column, grade: Column, n_exams: Column) -> DataFrame:
    normed = profiles.select(
        *PROFILE,
        F.try_divide("diff_day", days).alias("diff_day_norm"),
        F.try_divide("avg_grade", grade).alias("avg_grade_norm"),
        (F.col("n_exams").cast("double") / n_exams).alias("n_exams_norm"),
    )
    speed = (F.lit(1.0) - F.col("diff_day_norm")) * F.col("n_exams_norm")
    score = F.lit(float(grade_weight)) * F.col("avg_grade_norm") + F.lit(1.0 - grade_weight) * speed
    return normed.withColumn("score", score)


def grade_per_active_day(model: Model) -> DataFrame:
    """Mean grade of passed exams over the days from first to last session, per student.

    The question as asked, beside `fast_furious`: every enrolment counts for the days,
    passed or not. No passed exam with a grade, or a single day, gives a NULL ratio.
    """
    pairs = model.per_student(
        lambda m: m.rows(),
        F.avg(F.when(F.col("passed") == 1, F.col("grade"))).alias("avg_grade"),
        days_between(F.max("session_day"), F.min("session_day")).alias("active_days"),
    )
    ratio = F.try_divide("avg_grade", "active_days").alias("ratio")
    return model.label(pairs, "program").select(
        "program_code", "program", "student_id", "avg_grade", "active_days", ratio
    )
