"""Enrolments over time."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Model


def session_enrolments(model: Model) -> DataFrame:
    """Enrolments per program and session date."""
    per_date = model.totals([*model.keys("program"), "session_date"], n=F.lit(1))
    return dates_of(model, per_date)


def dates_of(model: Model, per_date: DataFrame) -> DataFrame:
    """The dates from `n` per program and session date."""
    return model.label(per_date, "program").select(
        "program_code",
        "program",
        model.full_year().alias("year"),
        "session_date",
        model.date().alias("date"),
        "n",
    )
