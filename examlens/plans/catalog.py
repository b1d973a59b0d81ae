"""Every operator as a query on the order tables, in both models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import days_between
from ..functions.text import short_label
from ..operators import activity, attempts, commitment, dashboard, distribution, distributions, grades, merit, pass_rate
from ..operators.model import Model, StarModel
from ..session import scratch_path, small_tasks
from ..sources import csv, dimension, export, layout, orders, sql, tables, views
from . import refresh
from .reports import REPORTS, choose_programs

Query = Callable[[SparkSession, str], DataFrame]
Stored = TypeVar("Stored", Model, DataFrame)

# name: (operator, reads the student, reads the exam)
OPERATORS: dict[str, tuple[Callable[[Model], DataFrame], bool, bool]] = {
    "session_enrolments": (distribution.session_enrolments, False, False),
    "exam_pass_rate": (pass_rate.exam_pass_rate, False, True),
    "hardest_exams": (pass_rate.hardest_exams, False, True),
    "hardest_exams_by_academic_year": (pass_rate.hardest_exams_by_academic_year, False, True),
    "hardest_exams_overall": (pass_rate.hardest_exams_overall, False, True),
    "same_day_load": (commitment.same_day_load, False, True),
    "commitment_rate": (commitment.commitment_rate, False, True),
    "exam_mean_grade": (grades.exam_mean_grade, False, True),
    "best_exams": (grades.best_exams, False, True),
    "worst_exams": (grades.worst_exams, False, True),
    "student_activity": (activity.student_activity, True, False),
    "lower_median": (activity.lower_median, True, False),
    "active_students": (activity.active_students, True, False),
    "activity_profile": (activity.activity_profile, True, False),
    "fast_furious": (activity.fast_furious, True, False),
    "weighted_fast_furious": (partial(activity.weighted_fast_furious, grade_weight=0.7), True, False),
    "fast_furious_deciles": (distributions.fast_furious_deciles, True, False),
    "fast_furious_by_weight": (distributions.fast_furious_by_weight, True, False),
    "grade_per_active_day": (activity.grade_per_active_day, True, False),
    "trial_and_error_by_program": (attempts.trial_and_error_by_program, True, True),
    "trial_and_error": (attempts.trial_and_error, True, True),
    "mean_attempts": (attempts.mean_attempts, True, True),
    "students_in_band_27": (partial(merit.students_in_band, low=27, high=28), True, False),
    "students_in_band_28": (partial(merit.students_in_band, low=28, high=29), True, False),
    "students_in_band_29": (partial(merit.students_in_band, low=29), True, False),
    "bands_27_28": (merit.bands_27_28, True, False),
    "merit_credits": (merit.merit_credits, True, False),
    "merit_credits_full": (merit.merit_credits_full, True, False),
}

# What a dashboard user has picked.
CHOSEN_PROGRAMS = [f"[N{n:02}] NATION_{n}" for n in (0, 2, 3, 5, 7, 8, 11, 13, 17, 19, 22, 24)]
CHOSEN_AREAS = ["AMERICA", "EUROPE"]


# Questions about the sessions alone: they have no use for a stored session table.
SESSIONS_ONLY = ("same_day_load", "commitment_rate")


def _star_model(spark: SparkSession, sf_dir: str, *, student: bool = True) -> StarModel:
    """The star tables of an input; its sessions, which are found in the line items, are stored once an application."""
    model = orders.star(spark, sf_dir, student=student)
    keep = lambda: layout.keep(model.session, scratch_path(spark, "sessions"))
    return replace(model, session=_laid_out(spark, sf_dir, "sessions", keep))


def _star(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    operator, student, _ = OPERATORS[name]
    make = orders.star if name in SESSIONS_ONLY else _star_model
    return operator(make(spark, sf_dir, student=student))


def _wide(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    operator, student, exam = OPERATORS[name]
    return operator(orders.wide(spark, sf_dir, student=student, exam=exam))


def _chosen(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose_programs({name: _star(name, spark, sf_dir)}, CHOSEN_PROGRAMS)[name]


def _with_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _star("exam_pass_rate", spark, sf_dir)
    return dashboard.with_program_dimension(rates, orders.program_dimension(spark, sf_dir))


def _chosen_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _star("exam_pass_rate", spark, sf_dir)
    return dashboard.filter_areas(rates, orders.program_dimension(spark, sf_dir), CHOSEN_AREAS)


def _area_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.area_department(orders.program_dimension(spark, sf_dir))


def _short_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = orders.read(spark, sf_dir, "documents")
    return texts.select("doc_id", short_label(F.col("text")).alias("label"))


def _session_dates(model: Model) -> DataFrame:
    """Every session date string with its year, date and days since the program's first."""
    dates = (
        model.offered()
        .groupBy("program_code", "session_date")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("program_code", "session_date", model.full_year().alias("year"), model.date().alias("date"))
    )
    # Over different dates only: as many rows a program as it has days.
    first = F.min("date").over(W.partitionBy("program_code"))
    return dates.select(*dates.columns, days_between(F.col("date"), first).alias("days"))


def _session_dates_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_dates(orders.star(spark, sf_dir, student=False))


def _session_dates_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_dates(orders.wide(spark, sf_dir, student=False, exam=False))


# The derived tables of an input are stored once an application and serve all queries on it.
_refreshed: dict[tuple[str, str, str], refresh.DerivedSet] = {}


def _derived(spark: SparkSession, sf_dir: str, kind: str = "star") -> refresh.DerivedSet:
    key = spark.sparkContext.applicationId, sf_dir, kind
    if key not in _refreshed:
        model = _star_model(spark, sf_dir) if kind == "star" else orders.wide(spark, sf_dir)
        _refreshed[key] = refresh.refresh(model, rows=orders.n_line_items(spark, sf_dir))
    return _refreshed[key]


def _derived_table(name: str, kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, kind).table(name)


def _derived_answer(name: str, kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return refresh.ANSWERS[name](_derived(spark, sf_dir, kind))


def _csv_report(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report from the derived tables, written as CSV and read back."""
    answer = _derived_answer(name, "star", spark, sf_dir)
    path = scratch_path(spark, name)
    REPORTS[name].write(answer, path)
    return csv.read_csv(spark, path, answer.schema)


def _stored_star(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator on the four tables stored under their original names."""
    root = scratch_path(spark, "stored_star")
    tables.write_star(orders.star(spark, sf_dir), root)
    return OPERATORS[name][0](tables.read_star(spark, root))


def _stored_wide(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator on the wide table stored under its original names."""
    path = scratch_path(spark, "stored_wide")
    tables.write_wide(orders.wide(spark, sf_dir), path)
    return OPERATORS[name][0](tables.read_wide(spark, path))


def _laid_out(spark: SparkSession, sf_dir: str, how: str, store: Callable[[], Stored]) -> Stored:
    """A stored layout of an input, once an application."""
    key = spark.sparkContext.applicationId, sf_dir, how
    if key not in _stored:
        _stored[key] = store()
    return _stored[key]


_stored: dict[tuple[str, str, str], Model | DataFrame] = {}


def _bucketed(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator on the star tables stored in buckets."""

    def store() -> Model:
        with small_tasks(spark, orders.n_line_items(spark, sf_dir)) as buckets:
            return layout.store_bucketed(_star_model(spark, sf_dir), buckets)

    return OPERATORS[name][0](_laid_out(spark, sf_dir, "bucketed", store))


def _pruned(name: str, chosen: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator on the wide table stored by program, of which only the chosen programs are read."""

    def store() -> Model:
        with small_tasks(spark, orders.n_line_items(spark, sf_dir)):
            return layout.store_by_program(orders.wide(spark, sf_dir), scratch_path(spark, "by_program"))

    wide = _laid_out(spark, sf_dir, "by_program", store)
    keep = lambda: layout.keep(orders.program_dimension(spark, sf_dir), scratch_path(spark, "dimension"))
    programs = chosen(_laid_out(spark, sf_dir, "dimension", keep))
    return OPERATORS[name][0](layout.narrowed(wide, programs))


def _of_programs(dimension: DataFrame) -> DataFrame:
    return dimension.where(F.col("program").isin(CHOSEN_PROGRAMS))


def _of_areas(dimension: DataFrame) -> DataFrame:
    return dimension.where(F.col("area").isin(CHOSEN_AREAS))


# Questions asked of each program by itself: they can be narrowed before they are computed.
BY_PROGRAM = ("session_enrolments", "exam_pass_rate", "hardest_exams", "commitment_rate", "best_exams", "worst_exams", "merit_credits")
BUCKETED = ("exam_pass_rate", "best_exams", "student_activity", "fast_furious", "merit_credits")


def _sql_on_temp_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL that reads a materialised temporary table twice."""
    model = orders.star(spark, sf_dir, student=False)
    views.temp_table(spark, "kept_means", grades.exam_mean_grade(model), materialise=True)
    return spark.sql(
        """
        SELECT program_code, program, count(*) AS n_exams, max(mean_grade) AS best_mean,
               (SELECT max(mean_grade) FROM kept_means) AS best_of_all
        FROM kept_means GROUP BY program_code, program
        """
    )


def _json_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The program dimension written as JSON records and read back."""
    path = scratch_path(spark, "program_dimension")
    dimension.write_program_dimension(orders.program_dimension(spark, sf_dir), path)
    return dimension.read_program_dimension(spark, path)


def _json_array_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The program dimension written as one array in a script and read back."""
    path = scratch_path(spark, "program_array")
    dimension.write_program_array(orders.program_dimension(spark, sf_dir), path)
    return dimension.read_program_array(spark, path)


def _export(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report exported as one file in parts and read back."""
    answer = _derived_answer(name, "star", spark, sf_dir)
    path = scratch_path(spark, f"export_{name}")
    export.export_csv(answer, path, REPORTS[name].columns())
    return export.read_export(spark, path, answer.schema)


def _statement(name: str, values: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL statement on the registered tables, reports and functions."""
    derived = _derived(spark, sf_dir)
    views.register_tables(spark, derived.model)
    refresh.register_reports(derived)
    sql.register_functions(spark)
    return sql.STATEMENTS[name].run(spark, **values)


PARAMETERS = {"commitment_top_n": {"programs": CHOSEN_PROGRAMS, "limit": 10}, "weighted_fast_furious": {"weight": 0.7}}
EXPORTED = ("session_enrolments", "best_exams", "fast_furious", "merit_credits")


def _sql_on_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over the registered tables, a derived one, which is stored, read twice."""
    derived = _derived(spark, sf_dir)
    views.register_tables(spark, derived.model)
    derived.register()
    return spark.sql(
        """
        SELECT g.program_code, p.program, count(*) AS n_exams, max(g.mean_grade) AS best_mean,
               (SELECT max(mean_grade) FROM exam_mean_grade) AS best_of_all
        FROM exam_mean_grade g JOIN program p ON p.program_code = g.program_code
        GROUP BY g.program_code, p.program
        """
    )


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in OPERATORS:
        found[name] = partial(_star, name)
        found[f"{name}_wide"] = partial(_wide, name)
    for name in REPORTS:
        found[f"chosen_{name}"] = partial(_chosen, name)
    found["commitment_top_n"] = found.pop("chosen_commitment_rate")
    found["filter_programs"] = partial(_chosen, "exam_pass_rate")
    found["filter_areas"] = _chosen_areas
    found["with_program_dimension"] = _with_dimension
    found["area_department"] = _area_department
    found["short_label"] = _short_label
    found["session_dates"] = _session_dates_star
    found["session_dates_wide"] = _session_dates_wide
    for name in REPORTS:
        found[f"csv_{name}"] = partial(_csv_report, name)
    for name in refresh.TABLES:
        found[f"derived_{name}"] = partial(_derived_table, name, "star")
        found[f"derived_{name}_wide"] = partial(_derived_table, name, "wide")
    for name in refresh.ANSWERS:
        found[f"derived_{name}_wide"] = partial(_derived_answer, name, "wide")
    for name in ("best_exams", "merit_credits"):
        found[f"stored_{name}"] = partial(_stored_star, name)
        found[f"stored_{name}_wide"] = partial(_stored_wide, name)
    for name in BUCKETED:
        found[f"bucketed_{name}"] = partial(_bucketed, name)
    for name in BY_PROGRAM:
        found[f"pruned_{name}"] = partial(_pruned, name, _of_programs)
    found["pruned_areas"] = partial(_pruned, "exam_pass_rate", _of_areas)
    found["sql_on_temp_table"] = _sql_on_temp_table
    found["json_program_dimension"] = _json_dimension
    found["json_array_program_dimension"] = _json_array_dimension
    for name in EXPORTED:
        found[f"export_{name}"] = partial(_export, name)
    for name in sql.STATEMENTS:
        found[f"sql_{name}"] = partial(_statement, name, PARAMETERS.get(name, {}))
    found["sql_on_views"] = _sql_on_views
    return found
