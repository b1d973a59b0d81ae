"""Session-scoped tables for SQL users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.activity import activity_profile, student_activity
from ..operators.grades import exam_mean_grade
from ..operators.merit import BANDS, bands_27_28, students_in_band
from ..operators.model import Model, StarModel
from ..operators.pass_rate import exam_pass_rate
from ..session import ensure_checkpoint_folder


def temp_table(spark: SparkSession, name: str, df: DataFrame, materialise: bool = False) -> DataFrame:
    """Replace the temporary table `name`.

    A view is enough for most uses: Spark prunes and pushes into it. `materialise`
    computes it once, with a checkpoint in the session's shared folder, which
    survives the loss of executors.
    """
    spark.catalog.dropTempView(name)
    if materialise:
        ensure_checkpoint_folder(spark)
        df = df.checkpoint()
    df.createOrReplaceTempView(name)
    return df


def register_tables(spark: SparkSession, model: Model) -> None:
    """The base tables: `program`, `exam`, `session`, `enrolment`, or `enrolment_wide`."""
    if isinstance(model, StarModel):
        for name in ("program", "exam", "session", "enrolment"):
            temp_table(spark, name, getattr(model, name))
    else:
        temp_table(spark, "enrolment_wide", model.enrolment)


def register_derived(spark: SparkSession, model: Model) -> None:
    """The shared intermediate results of the questions."""
    temp_table(spark, "exam_pass_rate", exam_pass_rate(model))
    temp_table(spark, "exam_mean_grade", exam_mean_grade(model))
    temp_table(spark, "student_activity", student_activity(model))
    temp_table(spark, "activity_profile", activity_profile(model))
    for low, high in BANDS.values():
        temp_table(spark, f"students_in_band_{low}", students_in_band(model, low, high))
    temp_table(spark, "bands_27_28", bands_27_28(model))
