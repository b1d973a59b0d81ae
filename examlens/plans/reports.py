"""The published reports: one ordered result per question, and the dashboard on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.activity import fast_furious
from ..operators.attempts import trial_and_error
from ..operators.commitment import commitment_rate, commitment_top_n
from ..operators.dashboard import filter_programs
from ..operators.distribution import session_enrolments
from ..operators.grades import best_exams, worst_exams
from ..operators.merit import merit_credits
from ..operators.model import Model
from ..operators.pass_rate import hardest_exams
from ..sources.csv import write_csv
from .refresh import ANSWERS, DerivedSet, refresh


@dataclass(frozen=True)
class Report:
    """A question and the order of its rows, always down to a unique key.

    A leading `-` means descending with NULLs last.
    """

    build: Callable[[Model], DataFrame]
    order: tuple[str, ...]

    def columns(self) -> list[Column]:
        return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc(c) for c in self.order]

    def write(self, answer: DataFrame, path: str, *, overwrite: bool = False) -> None:
        write_csv(answer, path, self.columns(), overwrite=overwrite)


REPORTS = {
    "session_enrolments": Report(session_enrolments, ("date", "program_code", "session_date")),
    "hardest_exams": Report(hardest_exams, ("program_code", "year", "ratio", "exam_code")),
    "commitment_rate": Report(commitment_rate, ("-commit_rate", "program")),
    "best_exams": Report(best_exams, ("program_code", "-mean_grade", "exam_code")),
    "worst_exams": Report(worst_exams, ("program_code", "mean_grade", "exam_code")),
    "fast_furious": Report(fast_furious, ("-score", "program_code", "student_id")),
    "trial_and_error": Report(trial_and_error, ("-attempts", "exam_code")),
    "merit_credits": Report(merit_credits, ("-credits", "program_code")),
}


def write_reports(model: Model, folder: str, *, overwrite: bool = False) -> None:
    """Every report as CSV under `folder/<name>`, in place of earlier ones if `overwrite`.

    The derived tables are computed once and serve all reports.
    """
    write_answers(refresh(model), folder, overwrite=overwrite)


def write_answers(derived: DerivedSet, folder: str, *, overwrite: bool = False) -> None:
    """Every report from tables that are stored already."""
    for name, report in REPORTS.items():
        report.write(ANSWERS[name](derived), f"{folder}/{name}", overwrite=overwrite)


def choose_programs(results: dict[str, DataFrame], programs: list[str]) -> dict[str, DataFrame]:
    """Every result narrowed to the chosen programs.

    Call it on the full results each time: a new choice replaces the one before.
    """
    return {
        name: commitment_top_n(result, programs)
        if name == "commitment_rate"
        else filter_programs(result, programs)
        for name, result in results.items()
    }
