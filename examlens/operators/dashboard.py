"""Program dimension, filters and labels on top of any result."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_code

ATTRIBUTES = ["area", "department", "degree_type", "language", "inactive"]


def _code(result: DataFrame) -> Column:
    """Programs are matched by code: labels are spelt differently in places."""
    return F.col("program_code") if "program_code" in result.columns else label_code(F.col("program"))


def _label_or_code(programs: str) -> str:
    label = re.match(r"\[([^\]]*)\]", programs)
    return label[1] if label else programs


def with_program_dimension(result: DataFrame, dimension: DataFrame) -> DataFrame:
    """The result with area, department, type, language and active flag of its program."""
    attributes = dimension.select(F.col("program_code").alias("_code"), *ATTRIBUTES)
    return result.join(attributes, _code(result) == F.col("_code"), "left").drop("_code")


def filter_programs(result: DataFrame, programs: list[str] | DataFrame) -> DataFrame:
    """Rows of the chosen programs, given by label or code or as a `program_code` table.

    A list becomes a table too: a plain filter would be pushed into one of several uses
    of a shared grouping, which then could not be shared.
    """
    if isinstance(programs, DataFrame):
        chosen = programs.select(F.col("program_code").alias("_code"))
    else:
        codes = F.array(*[F.lit(_label_or_code(p)) for p in programs]).cast("array<string>")
        chosen = result.sparkSession.range(1).select(F.explode(codes).alias("_code"))
    return result.join(chosen, _code(result) == F.col("_code"), "left_semi")


def filter_areas(result: DataFrame, dimension: DataFrame, areas: list[str]) -> DataFrame:
    """Rows of the programs of the chosen areas."""
    programs = dimension.filter(F.col("area").isin(areas))
    return filter_programs(result, programs)


def area_department(dimension: DataFrame) -> DataFrame:
    """Areas and their departments."""
    return (
        dimension.select(F.rtrim("area").alias("area"), F.rtrim("department").alias("department"))
        .distinct()
        .orderBy("area", "department")
    )
