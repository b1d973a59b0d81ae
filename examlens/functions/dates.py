"""Session date strings of the two models."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_dmy(text: Column) -> Column:
    """`d/m/yyyy`, day and month with one or two digits; anything else is NULL."""
    return F.try_to_date(text, "d/M/yyyy")


def parse_dmy2(text: Column) -> Column:
    """`dd/mm/yy` with a year of this century; anything else is NULL."""
    return F.try_to_date(text, "dd/MM/yy")


def days_between(last: Column, first: Column) -> Column:
    return F.datediff(last, first).cast("double")
