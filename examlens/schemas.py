"""Schemas of the exam model."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


PROGRAM = _schema(program_code=StringType(), program=StringType())

EXAM = _schema(exam_code=StringType(), exam=StringType())

SESSION = _schema(
    session_id=StringType(),
    program_code=StringType(),
    exam_code=StringType(),
    session_date=StringType(),
)

ENROLMENT = _schema(
    session_id=StringType(),
    student_id=LongType(),
    passed=IntegerType(),
    grade=IntegerType(),
)

ENROLMENT_WIDE = _schema(
    program_code=StringType(),
    program=StringType(),
    exam_code=StringType(),
    exam=StringType(),
    session_date=StringType(),
    student_id=LongType(),
    passed=IntegerType(),
    grade=IntegerType(),
)
