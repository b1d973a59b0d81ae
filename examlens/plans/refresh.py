"""The derived tables of the questions, computed once, stored, and shared by all reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, attempts, commitment, distribution, grades, merit, pass_rate, summary
from ..operators.model import Model, StarModel
from ..session import scratch_path, small_tasks
from ..sources.views import temp_table

SUMMARY = "summary"


@dataclass(frozen=True)
class DerivedSet:
    """The stored tables of one model below the folder `root`."""

    spark: SparkSession
    model: Model
    root: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def grain(self, name: str) -> DataFrame:
        return self.tables[SUMMARY].where(F.col("grain") == name)

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def store(self, name: str, df: DataFrame, *partitions: str) -> None:
        """Write a table once; all that follows reads the files."""
        path = f"{self.root}/{name}"
        df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
        self.tables[name] = self.spark.read.schema(df.schema).parquet(path)

    def register(self) -> None:
        """Put the tables in place of earlier ones of their names in the session."""
        for name, df in self.tables.items():
            temp_table(self.spark, name, df)


def _pass_rate(derived: DerivedSet) -> DataFrame:
    model = derived.model
    sums = derived.grain(summary.SESSIONS).withColumn("year", model.year())
    counts = sums.groupBy(*model.keys("program", "exam"), "year").agg(
        F.sum("n_passed").alias("n_passed"), F.sum("n").alias("n_enrolled")
    )
    return pass_rate.rates_of(model, counts)


def _mean_grade(derived: DerivedSet) -> DataFrame:
    model = derived.model
    rows = derived.grain(summary.SESSIONS)
    # An exam without passes is in no question; one passed without grades in the wide model's only.
    rows = rows.where("n_passed > 0" if model.keeps_ungraded_exams else "n_passed_grades > 0")
    sums = rows.groupBy(*model.keys("program", "exam")).agg(
        F.sum("passed_grades").alias("_grades"), F.sum("n_passed_grades").alias("_n")
    )
    return grades.means_of(model, sums)


def _pairs(derived: DerivedSet) -> DataFrame:
    return derived.grain(summary.STUDENTS).withColumn("n_exams", F.col("n"))


def _profiles(derived: DerivedSet) -> DataFrame:
    mean = F.try_divide(F.col("listed_grades").cast("double"), F.col("n_listed")).alias("avg_grade")
    keys = derived.model.keys("program")
    pairs = _pairs(derived).select("student_id", *keys, mean, "n_exams", "max_date", "min_date")
    profiles = activity.profiles_of(derived.model, pairs)
    return activity.active_of(profiles).select(*activity.PROFILE)


def _band(low: int, high: int | None) -> Callable[[DerivedSet], DataFrame]:
    def build(derived: DerivedSet) -> DataFrame:
        mean = F.try_divide(F.col("grades").cast("double"), F.col("n_grades")).alias("mean_grade")
        means = derived.grain(summary.STUDENTS).where("n_grades > 0")
        return merit.band_of(derived.model, means.select(*derived.model.keys("program"), mean), low, high)

    return build


# In the order in which they are computed: later ones read earlier ones.
TABLES: dict[str, Callable[[DerivedSet], DataFrame]] = {
    "exam_pass_rate": _pass_rate,
    "exam_mean_grade": _mean_grade,
    "student_activity": lambda d: activity.activity_of(d.model, _pairs(d)),
    "activity_profile": _profiles,
    **{f"students_in_band_{low}": _band(low, high) for low, high in merit.BANDS.values()},
    "bands_27_28": lambda d: merit.merge_bands(d.table("students_in_band_27"), d.table("students_in_band_28")),
}


def refresh(model: Model, root: str | None = None, *, rows: int | None = None) -> DerivedSet:
    """Compute and store all derived tables; the enrolments are scanned once, for the summary.

    A new folder is taken each time, so that readers of an earlier set are not disturbed
    and a lost executor repeats its own tasks only. The summary is partitioned by grain:
    a table reads the files of its grain and nothing else. `rows` is the number of
    enrolments, which sizes the tasks; it is counted if not known, which is cheap for a
    stored table.
    """
    spark = model.enrolment.sparkSession
    derived = DerivedSet(spark, model, root or scratch_path(spark, "derived"))
    with small_tasks(spark, model.enrolment.count() if rows is None else rows):
        derived.store(SUMMARY, summary.summarise(model), "grain")
        for name, build in TABLES.items():
            derived.store(name, build(derived))
    return derived


def register_reports(derived: DerivedSet) -> None:
    """The reports as temporary views, beside the tables they read."""
    derived.register()
    for name, answer in ANSWERS.items():
        temp_table(derived.spark, name, answer(derived))


def _session_enrolments(derived: DerivedSet) -> DataFrame:
    keys = [*derived.model.keys("program"), "session_date"]
    per_date = derived.grain(summary.SESSIONS).groupBy(*keys).agg(F.sum("n").alias("n"))
    return distribution.dates_of(derived.model, per_date)


def _commitment_rate(derived: DerivedSet) -> DataFrame:
    """The star model counts sessions without enrolments too, from its session table."""
    if isinstance(derived.model, StarModel):
        return commitment.commitment_rate(derived.model)
    keys = derived.model.keys("program")
    daily = derived.grain(summary.SESSIONS).groupBy("session_date", *keys)
    return commitment.rates_of(derived.model, daily.agg(F.countDistinct("exam_code").alias("n_exams")))


def _trial_and_error(derived: DerivedSet) -> DataFrame:
    failed = derived.grain(summary.FAILURES).withColumn("_failed", F.col("n_failed"))
    return attempts.most_attempts(attempts.attempts_of(derived.model, failed))


def _merit_credits(derived: DerivedSet) -> DataFrame:
    return merit.credits_of(
        derived.table("bands_27_28"), derived.table("students_in_band_29"), derived.model.top_band_join
    )


# The reports' answers from the stored tables.
ANSWERS: dict[str, Callable[[DerivedSet], DataFrame]] = {
    "session_enrolments": _session_enrolments,
    "hardest_exams": lambda d: pass_rate.hardest_of(d.table("exam_pass_rate")),
    "commitment_rate": _commitment_rate,
    "best_exams": lambda d: grades.best_of(d.table("exam_mean_grade")),
    "worst_exams": lambda d: grades.worst_of(d.table("exam_mean_grade")),
    "fast_furious": lambda d: activity.score_profiles(d.table("activity_profile")),
    "trial_and_error": _trial_and_error,
    "merit_credits": _merit_credits,
}
