"""Students per grade band and merit credits per program."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Model

# Band limits [low, high) and credits per student of the band.
BANDS = {"n27": (27, 28), "n28": (28, 29), "n29": (29, None)}
CREDITS = {"n27": 125, "n28": 250, "n29": 500}


def _inside(low: float, high: float | None) -> Column:
    mean = F.col("mean_grade")
    return mean >= low if high is None else (mean >= low) & (mean < high)


def _student_means(model: Model) -> DataFrame:
    return model.per_student(
        lambda m: m.rows().filter(F.col("grade").isNotNull()), F.avg("grade").alias("mean_grade")
    )


def students_in_band(model: Model, low: float, high: float | None = None) -> DataFrame:
    """Students per program whose mean grade is in [low, high)."""
    return band_of(model, _student_means(model), low, high)


def band_of(model: Model, means: DataFrame, low: float, high: float | None = None) -> DataFrame:
    """The band from `mean_grade` per student and program."""
    counts = means.filter(_inside(low, high)).groupBy(*model.keys("program")).agg(F.count("mean_grade").alias("n"))
    return model.label(counts, "program").select("program_code", "program", "n")


def band_counts(model: Model) -> DataFrame:
    """Students per program in every band, 0 where there are none.

    One grouping of the enrolments answers all bands. Programs without students
    in any band are left out.
    """
    counts = (
        _student_means(model)
        .filter(_inside(BANDS["n27"][0], None))
        .groupBy(*model.keys("program"))
        .agg(*[F.count_if(_inside(*limits)).alias(name) for name, limits in BANDS.items()])
    )
    return model.label(counts, "program").select("program_code", "program", *BANDS)


def _merged_27_28(counts: DataFrame) -> DataFrame:
    """Bands 27 and 28 merged by position, as the published figures are.

    A program without band 27 shows its band-28 count as `n27` and NULL as `n28`.
    """
    n27, n28 = F.nullif("n27", F.lit(0)), F.nullif("n28", F.lit(0))
    return counts.filter((F.col("n27") > 0) | (F.col("n28") > 0)).select(
        "program_code",
        "program",
        F.coalesce(n27, n28).alias("n27"),
        F.when(F.col("n27") > 0, n28).alias("n28"),
        F.nullif("n29", F.lit(0)).alias("n29"),
    )


def bands_27_28(model: Model) -> DataFrame:
    return _merged_27_28(band_counts(model)).drop("n29")


def _credits() -> Column:
    n27, n28, n29 = [F.col(name) * weight for name, weight in CREDITS.items()]
    return (n27 + n28 + n29).alias("credits")


def merit_credits(model: Model) -> DataFrame:
    """Credits from the merged bands; NULL where a band has no students.

    Programs with the top band only are left out. Those without the top band are
    kept by the wide model alone.
    """
    merged = _merged_27_28(band_counts(model))
    if model.top_band_join == "inner":
        merged = merged.filter(F.col("n29").isNotNull())
    return merged.select("*", _credits())


def merit_credits_full(model: Model) -> DataFrame:
    """Credits with every program that has students in any band, missing bands as 0."""
    return band_counts(model).select("*", _credits())


def merge_bands(n27: DataFrame, n28: DataFrame) -> DataFrame:
    """`bands_27_28` from the two bands' tables: their full outer join by program, merged by position."""
    other = n28.select("program_code", F.col("program").alias("_program"), F.col("n").alias("_n28"))
    both = n27.withColumnRenamed("n", "_n27").join(other, "program_code", "full_outer")
    return both.select(
        "program_code",
        F.coalesce("program", "_program").alias("program"),
        F.coalesce("_n27", "_n28").alias("n27"),
        F.when(F.col("_n27").isNotNull(), F.col("_n28")).alias("n28"),
    )


def credits_of(merged: DataFrame, n29: DataFrame, how: str) -> DataFrame:
    """`merit_credits` from the merged bands and the highest one; `how` is the model's final join."""
    top = n29.select("program_code", F.col("n").alias("n29"))
    return merged.join(top, "program_code", how).select("program_code", "program", *BANDS, _credits())
