"""Stored exam tables under their original Italian names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .. import schemas
from ..operators.model import StarModel, WideModel

# Original table and column names.
STAR_TABLES = {
    "program": ("cds", {"CdSCod": "program_code", "CdS": "program"}),
    "exam": ("ad", {"AdCod": "exam_code", "AD": "exam"}),
    "session": (
        "appelli",
        {
            "AppCod": "session_id",
            "CdSCod": "program_code",
            "AdCod": "exam_code",
            "DtAppello": "session_date",
        },
    ),
    "enrolment": (
        "iscrizioni",
        {"AppCod": "session_id", "Studente": "student_id", "Superamento": "passed", "Voto": "grade"},
    ),
}
WIDE_COLUMNS = {
    "CdSCod": "program_code",
    "CdS": "program",
    "AdCod": "exam_code",
    "AD": "exam",
    "DtAppello": "session_date",
    "Studente": "student_id",
    "Superamento": "passed",
    "Voto": "grade",
}
STAR_SCHEMAS = {
    "program": schemas.PROGRAM,
    "exam": schemas.EXAM,
    "session": schemas.SESSION,
    "enrolment": schemas.ENROLMENT,
}


def _load(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, escape='"')
    return reader.load(path)


def _conform(df: DataFrame, names: dict[str, str], schema: StructType) -> DataFrame:
    """Rename and cast; student ids keep their type, they are opaque.

    Grades are averaged as they are stored, fractions included. A value that is no
    number fails the query (ANSI casts, Spark's default).
    """
    columns = []
    for original, name in names.items():
        column, kind = F.col(original), schema[name].dataType
        if name != "student_id":
            column = column.cast(DoubleType() if name == "grade" else kind)
        columns.append(column.alias(name))
    return df.select(*columns)


def _store(df: DataFrame, names: dict[str, str], path: str) -> None:
    df.select(*[F.col(name).alias(original) for original, name in names.items()]).write.parquet(path)


def write_star(model: StarModel, root: str) -> None:
    """The four tables as Parquet under their original names, for `read_star`."""
    for name, (table, names) in STAR_TABLES.items():
        _store(getattr(model, name), names, f"{root}/{table}")


def write_wide(model: WideModel, path: str) -> None:
    """The wide table as Parquet under its original names, for `read_wide`."""
    _store(model.enrolment, WIDE_COLUMNS, path)


def read_star(spark: SparkSession, root: str, fmt: str = "parquet") -> StarModel:
    """The four tables stored as `root/<table>`."""
    return StarModel(
        **{
            name: _conform(_load(spark, f"{root}/{table}", fmt), names, STAR_SCHEMAS[name])
            for name, (table, names) in STAR_TABLES.items()
        }
    )


def read_wide(spark: SparkSession, path: str, fmt: str = "parquet") -> WideModel:
    """The wide table stored at `path`."""
    return WideModel(_conform(_load(spark, path, fmt), WIDE_COLUMNS, schemas.ENROLMENT_WIDE))
