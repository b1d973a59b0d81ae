"""Small hand-made models: every row is one enrolment, in both layouts."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from examlens import schemas
from examlens.operators.model import StarModel, WideModel


@dataclass(frozen=True)
class Row:
    program: str
    exam: str
    day: datetime.date
    student: int
    passed: int = 1
    grade: int | None = None


def day(number: int, year: int = 2018) -> datetime.date:
    return datetime.date(year, 1, 1) + datetime.timedelta(days=number)


def label(code: str) -> str:
    return f"[{code}] NAME {code}"


def dmy(d: datetime.date) -> str:
    return f"{d.day}/{d.month}/{d.year}"


def dmy2(d: datetime.date) -> str:
    return f"{d.day:02}/{d.month:02}/{d.year % 100:02}"


def session_id(program, exam, d) -> str:
    return f"{program}-{exam}-{d}"


def star_of(spark, rows, empty_sessions=()) -> StarModel:
    """`empty_sessions` are (program, exam, day) without enrolments."""
    held = sorted({(r.program, r.exam, r.day) for r in rows} | set(empty_sessions))
    programs = sorted({p for p, _, _ in held})
    exams = sorted({e for _, e, _ in held})
    return StarModel(
        program=spark.createDataFrame([(p, label(p)) for p in programs], schemas.PROGRAM),
        exam=spark.createDataFrame([(e, label(e)) for e in exams], schemas.EXAM),
        session=spark.createDataFrame(
            [(session_id(p, e, d), p, e, dmy(d)) for p, e, d in held], schemas.SESSION
        ),
        enrolment=spark.createDataFrame(
            [(session_id(r.program, r.exam, r.day), r.student, r.passed, r.grade) for r in rows],
            schemas.ENROLMENT,
        ),
    )


def wide_of(spark, rows) -> WideModel:
    return WideModel(
        spark.createDataFrame(
            [
                (r.program, label(r.program), r.exam, label(r.exam), dmy2(r.day), r.student, r.passed, r.grade)
                for r in rows
            ],
            schemas.ENROLMENT_WIDE,
        )
    )


def got(df, *columns, sort=True):
    found = [tuple(row) for row in df.select(*columns).collect()]
    return sorted(found, key=repr) if sort else found
