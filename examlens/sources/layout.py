"""Stored tables laid out for the questions: bucketed for joins and groupings, partitioned for selections."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.model import Model, StarModel, WideModel
from ..session import scratch_path

# A key with more rows than this is not put into a bucket.
HOT_ROWS = 5_000_000


def hot_keys(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The keys with more than `limit` rows; at most rows / limit of them."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return counts.select(*[F.col(k).alias(f"_{k}") for k in keys])


def split_by(rows: DataFrame, keys: list[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not among the `hot_keys`, and the others."""
    same = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = equal if same is None else same & equal
    return rows.join(hot, same, "left_anti"), rows.join(hot, same, "left_semi")


def split_hot(rows: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose key has at most `limit` rows, and the others.

    A bucket is read by one task, whatever its size, so a hot key must not be in one.
    """
    return split_by(rows, keys, hot_keys(rows, keys, limit))


def write_bucketed(rows: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Store `rows` as a table with one sorted file a bucket, and read it."""
    spark = rows.sparkSession
    dealt = rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    dealt.option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def keep(rows: DataFrame, path: str) -> DataFrame:
    """Store a table without any layout and read it: a small one is known to be small then."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass(frozen=True)
class BucketedStar(StarModel):
    """A star model whose enrolments are stored in buckets, twice.

    `enrolment` and `session` are bucketed by session, so their join moves nothing;
    `students` has the enrolments with their session's attributes bucketed by student
    and program, so that the student questions need neither join nor shuffle. Rows of
    hot keys are stored beside the buckets (`hot_sessions`, `hot_students`) and go the
    usual way; as no key is on both sides, the groups of the two are simply put together.
    """

    hot_sessions: DataFrame
    students: DataFrame
    hot_students: DataFrame

    def per_student(self, rows: Callable[[Model], DataFrame], *measures: Column) -> DataFrame:
        cold, hot = (StarModel.per_student(_Part(self, part), rows, *measures) for part in (self.students, self.hot_students))
        return cold.unionByName(hot)

    def rows(self) -> DataFrame:
        return self.students.unionByName(self.hot_students).drop("listed")

    def graded_rows(self) -> DataFrame:
        return _graded(self.students.unionByName(self.hot_students))

    def totals(self, keys: list[str], where: Column | None = None, **measures: Column) -> DataFrame:
        sums = None
        for enrolment in (self.enrolment, self.hot_sessions):
            rows = enrolment if where is None else enrolment.filter(where)
            per_session = rows.groupBy("session_id").agg(*[F.sum(v).alias(n) for n, v in measures.items()])
            part = per_session.join(self.session.withColumn("year", self.year()), "session_id")
            part = part.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in measures])
            sums = part if sums is None else sums.unionByName(part)
        return sums.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in measures])


def _graded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("grade", F.when(F.col("listed"), F.col("grade"))).drop("listed")


class _Part(StarModel):
    """The model with the student rows of one part only."""

    def __init__(self, model: BucketedStar, part: DataFrame):
        super().__init__(model.program, model.exam, model.session, model.enrolment)
        object.__setattr__(self, "part", part)

    def rows(self) -> DataFrame:
        return self.part.drop("listed")

    def graded_rows(self) -> DataFrame:
        return _graded(self.part)


def store_bucketed(model: StarModel, buckets: int, *, hot_rows: int = HOT_ROWS) -> BucketedStar:
    """Store a star model in buckets below the shared folder, as tables of the session's catalog.

    The number of buckets is fixed here and bounds the tasks of later queries: choose it
    as `session.shuffle_partitions` does for shuffles.

    The enrolments are computed once and stored as they come; the counts of their keys, the
    buckets and the rows beside them are made from the files. Each part meets the sessions
    by itself, so that the bucketed one is joined without a shuffle.
    """
    spark = model.enrolment.sparkSession
    root, name = scratch_path(spark, "bucketed"), f"bucketed_{uuid.uuid4().hex}"

    def kept(rows: DataFrame, part: str) -> DataFrame:
        return keep(rows, f"{root}/{part}")

    def bucketed(rows: DataFrame, part: str, *keys: str) -> DataFrame:
        return write_bucketed(rows, f"{name}_{part}", f"{root}/{part}", list(keys), buckets)

    def split(rows: DataFrame, part: str, *keys: str) -> tuple[DataFrame, DataFrame]:
        hot = kept(hot_keys(rows, list(keys), hot_rows), f"{part}_keys")
        cold, beside = split_by(rows, list(keys), hot)
        return bucketed(cold, part, *keys), kept(beside, f"hot_{part}")

    program, exam = kept(model.program, "program"), kept(model.exam, "exam")
    session = bucketed(model.session, "session", "session_id")
    enrolment, hot_sessions = split(kept(model.enrolment, "given"), "enrolment", "session_id")
    listed = exam.select("exam_code").distinct().withColumn("_listed", F.lit(True))
    held = session.withColumn("session_day", model.date()).join(listed, "exam_code", "left")
    held = held.withColumn("listed", F.coalesce("_listed", F.lit(False))).drop("_listed")
    joined = enrolment.join(held, "session_id").unionByName(hot_sessions.join(held, "session_id"))
    students, hot_students = split(kept(joined, "rows"), "students", "student_id", "program_code")
    return BucketedStar(program, exam, session, enrolment, hot_sessions, students, hot_students)


def store_by_program(model: WideModel, path: str) -> WideModel:
    """Store the wide table in a folder a program.

    AQE deals the rows to files of a good size: programs of any share are split, small
    ones are not scattered over all tasks.
    """
    rows = model.enrolment
    rows.hint("rebalance", "program_code").write.partitionBy("program_code").parquet(path)
    return WideModel(rows.sparkSession.read.schema(rows.schema).parquet(path))


def narrowed(model: WideModel, programs: DataFrame) -> WideModel:
    """The model of the chosen programs, a `program_code` table, before anything is computed.

    On a table stored by program, Spark prunes the folders by the codes it finds in
    `programs`, so that the other programs are never read. `programs` is a selection from
    a stored dimension that Spark knows to be small enough to broadcast. For questions asked of each
    program by itself; those that compare all students or exams need all programs.
    """
    return WideModel(model.enrolment.join(programs.select("program_code"), "program_code", "left_semi"))
