"""The queries of the catalog as DuckDB SQL over the order tables.

Written from the questions, in plain joins and groupings: what the DataFrame
operators merge into one pass is spelt out here step by step.
"""

from __future__ import annotations

from . import refresh
from .catalog import BUCKETED, BY_PROGRAM, CHOSEN_AREAS, CHOSEN_PROGRAMS, EXPORTED
from .reports import REPORTS

_BASE = """
WITH fact AS (
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS program_code,
         '[N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '] ' || n_name AS program,
         p_brand AS exam_code, '[' || p_brand || '] ' || p_brand AS exam,
         o_custkey AS student_id, CAST(l_shipdate + INTERVAL 16 YEAR AS DATE) AS held,
         CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS passed,
         CASE WHEN l_returnflag = 'R' OR l_linenumber = 7 THEN NULL
              ELSE 18 + CAST(l_quantity AS INTEGER) % 13 END AS grade
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
), dim AS (
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS program_code,
         '[N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '] ' || n_name AS program,
         r_name AS area, n_name AS department, 'Degree' AS degree_type, 'English' AS language,
         CAST(0 AS INTEGER) AS inactive
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

_STAR = _BASE + """, exams AS (
  SELECT DISTINCT p_brand AS exam_code, '[' || p_brand || '] ' || p_brand AS exam FROM part
), enrolment AS (
  SELECT program_code || '-' || exam_code || '-' || strftime(held, '%Y%m%d') AS session_id,
         student_id, passed, grade
  FROM fact
), sessions AS (
  SELECT DISTINCT program_code || '-' || exam_code || '-' || strftime(held, '%Y%m%d') AS session_id,
         program_code, exam_code, day(held) || '/' || month(held) || '/' || year(held) AS session_date
  FROM fact
), held AS (
  SELECT s.*, p.program, e.exam, right(session_date, 4) AS year, right(session_date, 4) AS long_year,
         CAST(try_strptime(session_date, '%d/%m/%Y') AS DATE) AS date
  FROM sessions s JOIN dim p USING (program_code) JOIN exams e USING (exam_code)
), rows_ AS (
  SELECT h.*, student_id, passed, grade FROM enrolment JOIN held h USING (session_id)
)"""

_WIDE = _BASE + """, enrolment_wide AS (
  SELECT program_code, program, exam_code, exam, strftime(held, '%d/%m/%y') AS session_date,
         student_id, passed, grade
  FROM fact
), rows_ AS (
  SELECT *, right(session_date, 2) AS year, '20' || right(session_date, 2) AS long_year,
         CAST(try_strptime(session_date, '%d/%m/%y') AS DATE) AS date
  FROM enrolment_wide
), held AS (SELECT * FROM rows_)"""

_RATES = """, enrolled AS (
  SELECT program_code, program, year, exam_code, exam, count(*) AS n
  FROM rows_ GROUP BY ALL
), succeeded AS (
  SELECT program_code, year, exam_code, count(*) AS n FROM rows_ WHERE passed = 1 GROUP BY ALL
), rates AS (
  SELECT e.program_code, program, e.year, e.exam_code, exam, e.n AS n_enrolled,
         coalesce(s.n, 0) AS n_passed, CAST(coalesce(s.n, 0) AS DOUBLE) * 100.0 / e.n AS ratio
  FROM enrolled e LEFT JOIN succeeded s
    ON s.program_code = e.program_code AND s.year = e.year AND s.exam_code = e.exam_code
)"""

_HARDEST = _RATES + """, ranked AS (
  SELECT program_code, exam_code,
         row_number() OVER (PARTITION BY program_code ORDER BY year, ratio, exam_code) AS place
  FROM rates
), hardest AS (
  SELECT * FROM rates r WHERE EXISTS (
    SELECT 1 FROM ranked k
    WHERE k.place <= 10 AND k.program_code = r.program_code AND k.exam_code = r.exam_code)
)"""

_LOAD = """, load AS (
  SELECT program, session_date, count(DISTINCT exam) AS n_exams FROM held GROUP BY program, session_date
), commitment AS (
  SELECT a.program, sum_commit, sum_all, CAST(sum_commit AS DOUBLE) / sum_all AS commit_rate
  FROM (SELECT program, CAST(sum(n_exams) AS BIGINT) AS sum_all FROM load GROUP BY program) a
  LEFT JOIN (SELECT program, CAST(sum(n_exams) AS BIGINT) AS sum_commit
             FROM load WHERE n_exams > 1 GROUP BY program) c ON c.program = a.program
)"""

_MEANS = """, means AS (
  SELECT program_code, program, exam_code, exam, avg(grade) AS mean_grade
  FROM rows_ WHERE passed = 1{graded} GROUP BY ALL
), placed AS (
  SELECT *,
    row_number() OVER (PARTITION BY program_code ORDER BY mean_grade DESC, exam_code) AS from_best,
    row_number() OVER (PARTITION BY program_code ORDER BY mean_grade, exam_code) AS from_worst
  FROM means WHERE program_code IS NOT NULL AND exam_code IS NOT NULL AND mean_grade IS NOT NULL
), best AS (SELECT * EXCLUDE (from_best, from_worst) FROM placed WHERE from_best <= 3),
worst AS (SELECT * EXCLUDE (from_best, from_worst) FROM placed WHERE from_worst <= 3)"""

_ACTIVITY = """, pairs AS (
  SELECT program, program_code, student_id, count(*) AS n_exams
  FROM rows_ GROUP BY program, program_code, student_id
), median AS (
  SELECT quantile_disc(n_exams, 0.5) AS lower_median FROM pairs
), active AS (
  SELECT * FROM pairs WHERE n_exams >= (SELECT lower_median FROM median)
), graded AS (
  SELECT program_code, student_id, avg(grade) AS mean FROM rows_
  WHERE grade IS NOT NULL GROUP BY program_code, student_id
), profile AS (
  SELECT a.program_code, a.program, a.student_id, {ungraded} AS avg_grade, a.n_exams,
         max(r.date) AS max_date, min(r.date) AS min_date,
         CAST(max(r.date) - min(r.date) AS DOUBLE) AS diff_day
  FROM active a
  JOIN rows_ r ON r.program_code = a.program_code AND r.student_id = a.student_id
  LEFT JOIN graded g ON g.program_code = a.program_code AND g.student_id = a.student_id
  GROUP BY a.program_code, a.program, a.student_id, a.n_exams, g.mean
), normed AS (
  SELECT *, diff_day / nullif((SELECT max(diff_day) FROM profile), 0) AS diff_day_norm,
         avg_grade / nullif((SELECT max(avg_grade) FROM profile), 0) AS avg_grade_norm,
         CAST(n_exams AS DOUBLE) / (SELECT max(n_exams) FROM profile) AS n_exams_norm
  FROM profile
), scored AS (
  SELECT *, CAST({weight} AS DOUBLE) * avg_grade_norm
            + (CAST(1.0 AS DOUBLE) - CAST({weight} AS DOUBLE))
              * ((CAST(1.0 AS DOUBLE) - diff_day_norm) * n_exams_norm) AS score
  FROM normed
)"""

_ATTEMPTS = """, failures AS (
  SELECT exam_code, exam, program, student_id, count(*) AS n
  FROM rows_ WHERE passed = 0 GROUP BY exam_code, exam, program, student_id
), attempts AS (
  SELECT exam_code, exam, min(program) AS program, avg(n) AS attempts
  FROM failures GROUP BY exam_code, exam
), most AS (SELECT * FROM attempts ORDER BY attempts DESC, exam_code LIMIT 3)"""

_BANDS = """, student_means AS (
  SELECT program_code, program, student_id, avg(grade) AS mean
  FROM rows_ GROUP BY program_code, program, student_id
), b27 AS (
  SELECT program_code, program, count(mean) AS n FROM student_means
  WHERE mean >= 27 AND mean < 28 GROUP BY program_code, program
), b28 AS (
  SELECT program_code, program, count(mean) AS n FROM student_means
  WHERE mean >= 28 AND mean < 29 GROUP BY program_code, program
), b29 AS (
  SELECT program_code, program, count(mean) AS n FROM student_means
  WHERE mean >= 29 GROUP BY program_code, program
), merged AS (
  SELECT program_code, coalesce(a.program, b.program) AS program,
         coalesce(a.n, b.n) AS n27, CASE WHEN a.n IS NOT NULL THEN b.n END AS n28
  FROM b27 a FULL JOIN b28 b USING (program_code)
), credited AS (
  SELECT m.*, c.n AS n29, n27 * 125 + n28 * 250 + c.n * 500 AS credits
  FROM merged m {top_join} JOIN b29 c ON c.program_code = m.program_code
), any_band AS (
  SELECT program_code, program FROM b27 UNION SELECT program_code, program FROM b28
  UNION SELECT program_code, program FROM b29
), full_credits AS (
  SELECT program_code, p.program, coalesce(a.n, 0) AS n27, coalesce(b.n, 0) AS n28,
         coalesce(c.n, 0) AS n29,
         coalesce(a.n, 0) * 125 + coalesce(b.n, 0) * 250 + coalesce(c.n, 0) * 500 AS credits
  FROM any_band p LEFT JOIN b27 a USING (program_code) LEFT JOIN b28 b USING (program_code)
  LEFT JOIN b29 c USING (program_code)
)"""

_SESSION_DATES = """, dates AS (
  SELECT DISTINCT program_code, session_date, long_year AS year, date FROM held
)
SELECT d.*, CAST(date - min(date) OVER (PARTITION BY program_code) AS DOUBLE) AS days
FROM dates d"""

# name: (tables built on the enrolments, final select)
_OPERATORS = {
    "session_enrolments": (
        "",
        """
SELECT program_code, program, long_year AS year, session_date, date, count(*) AS n
FROM rows_ GROUP BY ALL""",
    ),
    "exam_pass_rate": (_RATES, "SELECT * FROM rates"),
    "hardest_exams": (_HARDEST, "SELECT * FROM hardest"),
    "hardest_exams_overall": (_RATES, """SELECT * FROM rates
WHERE program_code IS NOT NULL AND exam_code IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY program_code, year ORDER BY ratio, exam_code) <= 10"""),
    "hardest_exams_by_academic_year": ("", """SELECT program_code, program, academic_year, exam_code, exam,
  count(*) AS n_enrolled, count(*) FILTER (WHERE passed = 1) AS n_passed,
  CAST(count(*) FILTER (WHERE passed = 1) AS DOUBLE) * 100.0 / count(*) AS ratio
FROM (SELECT *, year(date) - CASE WHEN month(date) < 10 THEN 1 ELSE 0 END AS y,
        CAST(y AS VARCHAR) || '/' || CAST(y + 1 AS VARCHAR) AS academic_year FROM rows_)
GROUP BY program_code, program, academic_year, exam_code, exam
QUALIFY row_number() OVER (PARTITION BY program_code, academic_year ORDER BY ratio, exam_code) <= 10"""),
    "same_day_load": (_LOAD, "SELECT * FROM load"),
    "commitment_rate": (_LOAD, "SELECT * FROM commitment"),
    "exam_mean_grade": (_MEANS, "SELECT * FROM means"),
    "best_exams": (_MEANS, "SELECT * FROM best"),
    "worst_exams": (_MEANS, "SELECT * FROM worst"),
    "student_activity": (_ACTIVITY, "SELECT * FROM pairs"),
    "lower_median": (_ACTIVITY, "SELECT * FROM median"),
    "active_students": (_ACTIVITY, "SELECT * FROM active"),
    "activity_profile": (_ACTIVITY, "SELECT * FROM profile"),
    "fast_furious": (_ACTIVITY, "SELECT * FROM scored"),
    "weighted_fast_furious": (_ACTIVITY, "SELECT * FROM scored"),
    "fast_furious_deciles": (_ACTIVITY, """SELECT program_code, program, part AS decile, score, n AS n_students
FROM (SELECT program_code, program, score, count(*) OVER (PARTITION BY program_code, program) AS n,
        row_number() OVER (PARTITION BY program_code, program ORDER BY score) AS place
      FROM scored WHERE score IS NOT NULL)
JOIN (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS part) ON place = (n * part + 9) // 10"""),
    "fast_furious_by_weight": (_ACTIVITY, """SELECT program_code, program, weight,
  CAST(row_number() OVER (PARTITION BY program_code, program, weight ORDER BY score DESC, student_id) AS INTEGER) AS rank,
  student_id, score
FROM (SELECT program_code, program, student_id, weight,
        weight * avg_grade_norm
        + (CAST(1.0 AS DOUBLE) - weight) * ((CAST(1.0 AS DOUBLE) - diff_day_norm) * n_exams_norm) AS score
      FROM scored, (SELECT CAST(unnest(range(101)) AS DOUBLE) / 100 AS weight))
WHERE score IS NOT NULL QUALIFY rank <= 3"""),
    "grade_per_active_day": ("", """SELECT program_code, program, student_id,
  avg(grade) FILTER (WHERE passed = 1) AS avg_grade,
  CAST(max(date) - min(date) AS DOUBLE) AS active_days,
  avg(grade) FILTER (WHERE passed = 1) / nullif(CAST(max(date) - min(date) AS DOUBLE), 0) AS ratio
FROM rows_ GROUP BY program_code, program, student_id"""),
    "trial_and_error_by_program": (""", tries AS (
  SELECT program_code, program, student_id, exam_code, count(*) FILTER (WHERE passed = 0) AS n
  FROM rows_ GROUP BY program_code, program, student_id, exam_code
)""", "SELECT program_code, program, avg(n) AS attempts FROM tries GROUP BY program_code, program"),
    "trial_and_error": (_ATTEMPTS, "SELECT * FROM most"),
    "mean_attempts": (_ATTEMPTS, "SELECT * FROM attempts"),
    "students_in_band_27": (_BANDS, "SELECT * FROM b27"),
    "students_in_band_28": (_BANDS, "SELECT * FROM b28"),
    "students_in_band_29": (_BANDS, "SELECT * FROM b29"),
    "bands_27_28": (_BANDS, "SELECT * FROM merged"),
    "merit_credits": (_BANDS, "SELECT * FROM credited"),
    "merit_credits_full": (_BANDS, "SELECT * FROM full_credits"),
}

_WEIGHTS = {"weighted_fast_furious": "0.7"}

_CHOSEN = {
    "chosen_session_enrolments": "session_enrolments",
    "chosen_hardest_exams": "hardest_exams",
    "chosen_best_exams": "best_exams",
    "chosen_worst_exams": "worst_exams",
    "chosen_fast_furious": "fast_furious",
    "chosen_trial_and_error": "trial_and_error",
    "chosen_merit_credits": "merit_credits",
    "filter_programs": "exam_pass_rate",
}


def _fill(text: str, **values: str) -> str:
    for name, value in values.items():
        text = text.replace("{" + name + "}", value)
    return text


def _sql(name: str, model: str = "star", suffix: str = "") -> str:
    tables, select = _OPERATORS[name]
    star = model == "star"
    return _fill(
        (_STAR if star else _WIDE) + tables + "\n" + select + suffix,
        ungraded="coalesce(g.mean, 0)" if star else "g.mean",
        weight=_WEIGHTS.get(name, "0.5"),
        top_join="" if star else "LEFT",
        # The normalised question drops exams without a grade, the wide one keeps them.
        graded=" AND grade IS NOT NULL" if star else "",
    )


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in _OPERATORS:
        found[name] = _sql(name)
        found[f"{name}_wide"] = _sql(name, "wide")
    programs = ", ".join(f"'{label}'" for label in CHOSEN_PROGRAMS)
    areas = ", ".join(f"'{area}'" for area in CHOSEN_AREAS)
    for key, name in _CHOSEN.items():
        found[key] = f"SELECT * FROM ({_sql(name)}) AS result WHERE program IN ({programs})"
    found["commitment_top_n"] = _sql(
        "commitment_rate",
        suffix=f"\nWHERE program IN ({programs}) ORDER BY commit_rate DESC NULLS LAST, program LIMIT 10",
    )
    found["filter_areas"] = _sql(
        "exam_pass_rate",
        suffix=f"\nWHERE program_code IN (SELECT program_code FROM dim WHERE area IN ({areas}))",
    )
    found["with_program_dimension"] = (
        _STAR
        + _RATES
        + """
SELECT r.*, area, department, degree_type, language, inactive
FROM rates r LEFT JOIN dim d ON d.program_code = r.program_code"""
    )
    found["area_department"] = _BASE + """
SELECT DISTINCT rtrim(area) AS area, rtrim(department) AS department FROM dim"""
    found["short_label"] = """
SELECT doc_id, CASE WHEN length(text) > 65 THEN substring(text, 1, 61) || '...' ELSE text END AS label
FROM documents"""
    found["session_dates"] = _STAR + _SESSION_DATES
    found["session_dates_wide"] = _WIDE + _SESSION_DATES
    for name in REPORTS:
        found[f"csv_{name}"] = _sql(name)
    for name in refresh.TABLES:
        found[f"derived_{name}"] = _sql(name)
        found[f"derived_{name}_wide"] = _sql(name, "wide")
    for name in refresh.ANSWERS:
        found[f"derived_{name}_wide"] = _sql(name, "wide")
    for name in ("best_exams", "merit_credits"):
        found[f"stored_{name}"] = _sql(name)
        found[f"stored_{name}_wide"] = _sql(name, "wide")
    for name in BUCKETED:
        found[f"bucketed_{name}"] = _sql(name)
    for name in BY_PROGRAM:
        found[f"pruned_{name}"] = f"SELECT * FROM ({_sql(name, 'wide')}) AS result WHERE program IN ({programs})"
    found["pruned_areas"] = _sql(
        "exam_pass_rate",
        "wide",
        suffix=f"\nWHERE program_code IN (SELECT program_code FROM dim WHERE area IN ({areas}))",
    )
    found["json_program_dimension"] = _BASE + """
SELECT program_code, program, area, department AS name, department, degree_type, language, inactive FROM dim"""
    found["json_array_program_dimension"] = found["json_program_dimension"]
    for name in EXPORTED:
        found[f"export_{name}"] = _sql(name)
    found["sql_top_exams"] = _sql("best_exams")
    found["sql_hardest_exams"] = _sql("hardest_exams")
    found["sql_commitment_top_n"] = found["commitment_top_n"]
    found["sql_weighted_fast_furious"] = _sql("weighted_fast_furious")
    found["sql_labels"] = _STAR + _RATES + """
SELECT program_code, exam_code,
       CASE WHEN length(program || ' ' || exam) > 65 THEN substring(program || ' ' || exam, 1, 61) || '...'
            ELSE program || ' ' || exam END AS label,
       replace(regexp_replace(CAST(CAST(sum(n_passed) AS DOUBLE) * 100.0 / sum(n_enrolled) AS VARCHAR), '[.]0$', ''), '.', ',') AS rate,
       CAST(sum(n_passed) AS VARCHAR) AS passed,
       CAST(max(make_date(CAST(year AS INTEGER), 12, 31) - make_date(CAST(year AS INTEGER), 1, 1)) AS DOUBLE) AS days,
       make_date(CAST(max(year) AS INTEGER), 12, 31) AS until
FROM rates GROUP BY program_code, program, exam_code, exam"""
    found["sql_on_views"] = found["sql_on_temp_table"] = (
        _STAR
        + _fill(_MEANS, graded=" AND grade IS NOT NULL")
        + """
SELECT program_code, program, count(*) AS n_exams, max(mean_grade) AS best_mean,
       (SELECT max(mean_grade) FROM means) AS best_of_all
FROM means GROUP BY program_code, program"""
    )
    return found
