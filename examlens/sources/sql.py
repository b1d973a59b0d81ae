"""What a SQL user needs: functions of the session, and statements with parameters on the registered tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import LABEL_KEPT, LABEL_LIMIT

# name: (parameters, type, body); Catalyst puts the body in place of every call.
FUNCTIONS = {
    "short_label": (
        "label STRING",
        "STRING",
        f"CASE WHEN char_length(label) > {LABEL_LIMIT} THEN substring(label, 1, {LABEL_KEPT}) || '...' ELSE label END",
    ),
    "label_code": ("label STRING", "STRING", r"regexp_extract(label, '^\\[([^\\]]+)\\]', 1)"),
    "decimal_comma": (
        "number DOUBLE",
        "STRING",
        r"translate(regexp_replace(CAST(number AS STRING), '\\.0$', ''), '.', ',')",
    ),
    "parse_dmy": ("text STRING", "DATE", "try_to_date(text, 'd/M/yyyy')"),
    "parse_dmy2": ("text STRING", "DATE", "try_to_date(text, 'dd/MM/yy')"),
    "days_between": ("last_day DATE, first_day DATE", "DOUBLE", "CAST(datediff(last_day, first_day) AS DOUBLE)"),
}


def register_functions(spark: SparkSession) -> None:
    """Put the functions in place of earlier ones of their names in the session."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


def _number(low: float, high: float) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and low <= x <= high


def _count(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def _texts(x: Any) -> bool:
    return isinstance(x, list) and all(isinstance(t, str) for t in x)


@dataclass(frozen=True)
class Statement:
    """A query with named parameters, and what each of them may be."""

    text: str
    allowed: dict[str, Callable[[Any], bool]] = field(default_factory=dict)

    def run(self, spark: SparkSession, **values: Any) -> DataFrame:
        """The answer; values reach Spark as literals and never as text of the query."""
        if set(values) != set(self.allowed):
            raise ValueError(f"the parameters are {sorted(self.allowed)}")
        for name, allowed in self.allowed.items():
            if not allowed(values[name]):
                raise ValueError(f"{values[name]!r} is no value for {name}")
        return spark.sql(self.text, args=values)


# On the tables of a refreshed set and its reports. The first rows of each program are asked
# for program by program (LATERAL), with their rank spelt out: Spark turns a correlated ORDER BY
# ... LIMIT into a rank without an order, whose rows depend on a sort below the shuffle.
STATEMENTS = {
    "top_exams": Statement(
        """
        SELECT p.program_code, p.program, best.exam_code, best.exam, best.mean_grade
        FROM program p, LATERAL (
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY program_code ORDER BY mean_grade DESC, exam_code) AS place
                FROM exam_mean_grade WHERE exam_code IS NOT NULL AND mean_grade IS NOT NULL) g
            WHERE g.program_code = p.program_code AND place <= 3) best
        """
    ),
    # All years of the exams that are among the first rows of their program.
    "hardest_exams": Statement(
        """
        SELECT r.* FROM exam_pass_rate r
        WHERE EXISTS (
            SELECT 1 FROM (
                SELECT program_code, exam_code,
                       row_number() OVER (PARTITION BY program_code ORDER BY year, ratio, exam_code) AS place
                FROM exam_pass_rate WHERE program_code IS NOT NULL AND exam_code IS NOT NULL) hard
            WHERE hard.program_code = r.program_code AND hard.exam_code = r.exam_code AND place <= 10)
        """
    ),
    "commitment_top_n": Statement(
        """
        SELECT * FROM commitment_rate WHERE array_contains(:programs, program)
        ORDER BY commit_rate DESC NULLS LAST, program LIMIT :limit
        """,
        {"programs": _texts, "limit": _count},
    ),
    "weighted_fast_furious": Statement(
        """
        SELECT program_code, program, student_id, avg_grade, n_exams, max_date, min_date, diff_day,
               diff_day_norm, avg_grade_norm, n_exams_norm,
               CAST(:weight AS DOUBLE) * avg_grade_norm
               + (CAST(1 AS DOUBLE) - CAST(:weight AS DOUBLE)) * ((CAST(1 AS DOUBLE) - diff_day_norm) * n_exams_norm) AS score
        FROM fast_furious
        """,
        {"weight": _number(0, 1)},
    ),
    "labels": Statement(
        """
        SELECT r.program_code, label_code(r.exam) AS exam_code, short_label(r.program || ' ' || r.exam) AS label,
               decimal_comma(CAST(sum(n_passed) AS DOUBLE) * CAST(100 AS DOUBLE) / sum(n_enrolled)) AS rate, decimal_comma(sum(n_passed)) AS passed,
               max(days_between(parse_dmy('31/12/' || r.year), parse_dmy('1/1/' || r.year))) AS days,
               parse_dmy2('31/12/' || right(max(r.year), 2)) AS until
        FROM exam_pass_rate r GROUP BY r.program_code, r.program, r.exam
        """
    ),
}
