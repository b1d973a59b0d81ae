"""The two data models and what each business operator needs from them.

`StarModel` is normalised (program, exam, session, enrolment), `WideModel` is one
table with a row per enrolment. The operators are written once against the methods
below; the few places where the two models answer differently are attributes here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_dmy, parse_dmy2

Measures = dict[str, Column]


def _sums(measures: Measures) -> list[Column]:
    return [F.sum(value).alias(name) for name, value in measures.items()]


@dataclass(frozen=True)
class StarModel:
    program: DataFrame
    exam: DataFrame
    session: DataFrame
    enrolment: DataFrame

    # Mean grade of a student without any grade.
    ungraded_mean = 0.0
    # How programs without students of the highest band enter the merit credits.
    top_band_join = "inner"
    # Whether exams passed without any grade have a (NULL) mean.
    keeps_ungraded_exams = False

    def keys(self, *entities: str) -> list[str]:
        """Grouping columns of the entities `program` and `exam`."""
        return [f"{entity}_code" for entity in entities]

    def label(self, df: DataFrame, *entities: str) -> DataFrame:
        """Add the labels and drop rows whose code is in no dimension.

        Applied to aggregates, after the big shuffle. No broadcast hint: Spark
        broadcasts a dimension when its file or measured size allows it.
        """
        for entity in entities:
            df = df.join(getattr(self, entity), f"{entity}_code")
        return df

    def date(self) -> Column:
        return parse_dmy(F.col("session_date"))

    def year(self) -> Column:
        return F.right(F.col("session_date"), F.lit(4))

    full_year = year

    def offered(self) -> DataFrame:
        """Exam sessions held, with or without enrolments."""
        return self.session.join(self.exam.select("exam_code"), "exam_code", "left_semi")

    def rows(self) -> DataFrame:
        """Enrolments with program, exam and parsed date.

        The date is parsed on the session side, before the join. A session with a
        large share of all enrolments is split by AQE's skew join.
        """
        return self.enrolment.join(self.session.withColumn("session_day", self.date()), "session_id")

    def graded_rows(self) -> DataFrame:
        """As `rows`; a grade in an exam that is missing from the exam table is NULL."""
        listed = self.exam.select("exam_code").distinct().withColumn("_listed", F.lit(True))
        sessions = self.session.withColumn("session_day", self.date()).join(listed, "exam_code", "left")
        rows = self.enrolment.join(sessions, "session_id")
        return rows.withColumn("grade", F.when(F.col("_listed"), F.col("grade"))).drop("_listed")

    def per_student(self, rows: Callable[[Model], DataFrame], *measures: Column) -> DataFrame:
        """Aggregates of the model's `rows` per student and program."""
        return rows(self).groupBy("student_id", *self.keys("program")).agg(*measures)

    def totals(self, keys: list[str], where: Column | None = None, **measures: Column) -> DataFrame:
        """Sums of row measures per group of session attributes (`year` included).

        Enrolments are summed per session before they meet the session table, so
        what is shuffled and joined is one row per session and task: a hot session
        costs no more than any other.
        """
        rows = self.enrolment if where is None else self.enrolment.filter(where)
        per_session = rows.groupBy("session_id").agg(*_sums(measures))
        return (
            per_session.join(self.session.withColumn("year", self.year()), "session_id")
            .groupBy(*keys)
            .agg(*[F.sum(name).alias(name) for name in measures])
        )


@dataclass(frozen=True)
class WideModel:
    enrolment: DataFrame

    ungraded_mean = None
    top_band_join = "left"
    keeps_ungraded_exams = True

    def keys(self, *entities: str) -> list[str]:
        return [f"{entity}{suffix}" for entity in entities for suffix in ("_code", "")]

    def label(self, df: DataFrame, *entities: str) -> DataFrame:
        return df

    def date(self) -> Column:
        return parse_dmy2(F.col("session_date"))

    def year(self) -> Column:
        return F.right(F.col("session_date"), F.lit(2))

    def full_year(self) -> Column:
        return F.concat(F.lit("20"), self.year())

    def offered(self) -> DataFrame:
        """Only sessions with enrolments are known to the wide table."""
        return self.enrolment

    def graded_rows(self) -> DataFrame:
        return self.rows()

    def rows(self) -> DataFrame:
        return self.enrolment.withColumn("session_day", self.date())

    def per_student(self, rows: Callable[[Model], DataFrame], *measures: Column) -> DataFrame:
        return rows(self).groupBy("student_id", *self.keys("program")).agg(*measures)

    def totals(self, keys: list[str], where: Column | None = None, **measures: Column) -> DataFrame:
        rows = self.enrolment if where is None else self.enrolment.filter(where)
        return rows.withColumn("year", self.year()).groupBy(*keys).agg(*_sums(measures))


Model = StarModel | WideModel
