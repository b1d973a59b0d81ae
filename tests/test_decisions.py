"""One hand-made case per decision about the meaning of the questions."""

import datetime

import pytest
from pyspark.sql import functions as F

from examlens.functions.dates import parse_dmy, parse_dmy2
from examlens.functions.ranking import top_k, upper_half
from examlens.functions.text import decimal_comma, label_code, short_label
from examlens.operators import activity, attempts, commitment, dashboard, grades, merit, pass_rate
from mini import Row, day, got, label, star_of, wide_of


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_dates_with_one_or_two_digits(spark):
    texts = ["1/2/2018", "12/1/2018", "1/12/2018", "12/11/2018", "31/2/2018", "32/1/2018", "x", None]
    found = column(spark, texts).select(parse_dmy(F.col("v"))).collect()
    expected = [(2018, 2, 1), (2018, 1, 12), (2018, 12, 1), (2018, 11, 12)]
    assert [r[0] for r in found] == [datetime.date(*d) for d in expected] + [None] * 4


def test_dates_with_short_year(spark):
    found = column(spark, ["05/02/18", "5/2/18", "29/02/17", None]).select(parse_dmy2(F.col("v"))).collect()
    assert [r[0] for r in found] == [datetime.date(2018, 2, 5), None, None, None]


def test_hardest_exams_are_chosen_by_the_earliest_year(spark):
    rates = spark.createDataFrame(
        [
            ("P", "a1", "2018", 10.0),
            ("P", "a1", "2019", 1.0),
            ("P", "a2", "2018", 20.0),
            ("P", "a3", "2018", 30.0),
            ("Q", "a1", "2018", 5.0),
        ],
        "program_code string, exam_code string, year string, ratio double",
    )
    found = got(pass_rate.hardest_of(rates, 2), "program_code", "exam_code", "year")
    assert found == [("P", "a1", "2018"), ("P", "a1", "2019"), ("P", "a2", "2018"), ("Q", "a1", "2018")]


def test_equal_means_are_ranked_by_exam_code(spark):
    rows = [Row("P", f"e{n}", day(n), 1, 1, 30) for n in (5, 4, 3, 2, 1)] + [Row("Q", "e1", day(0), 1, 1, 25)]
    for model in (star_of(spark, rows), wide_of(spark, rows)):
        for operator in (grades.best_exams, grades.worst_exams):
            found = got(operator(model), "program_code", "exam_code", "mean_grade")
            assert found == [("P", "e1", 30.0), ("P", "e2", 30.0), ("P", "e3", 30.0), ("Q", "e1", 25.0)]


COMMITMENT = [
    Row("P", "e1", day(1), 1),
    Row("P", "e2", day(1), 1),
    Row("P", "e2", day(1), 2),
    Row("P", "e1", day(2), 1),
    Row("Q", "e1", day(1), 1),
]


def test_commitment_is_null_without_shared_days(spark):
    for model in (star_of(spark, COMMITMENT), wide_of(spark, COMMITMENT)):
        found = got(commitment.commitment_rate(model), "program", "sum_commit", "sum_all", "commit_rate")
        assert found == [(label("P"), 2, 3, 2 / 3), (label("Q"), None, 1, None)]


def test_sessions_without_enrolments_count_in_the_star_model_only(spark):
    model = star_of(spark, COMMITMENT, empty_sessions=[("P", "e3", day(3))])
    found = got(commitment.commitment_rate(model), "program", "sum_commit", "sum_all", "commit_rate")
    assert found[0] == (label("P"), 2, 4, 0.5)


@pytest.mark.parametrize(
    "counts, median", [([1, 2, 3, 4], 2), ([1, 2, 3], 2), ([5], 5), ([1, 1, 1, 9], 1), ([2, 7], 2), ([], None)]
)
def test_lower_median(spark, counts, median):
    found = upper_half(column(spark, counts, "bigint"), "v")
    expected = sorted({c for c in counts if c >= median}) if counts else []
    assert got(found, "v", "lower_median", "max_v") == [(c, median, max(counts)) for c in expected]


def test_active_students(spark):
    rows = [Row("P", f"e{k}", day(k), n) for n in (1, 2, 3, 4) for k in range(n)]
    for model in (star_of(spark, rows), wide_of(spark, rows)):
        assert got(activity.active_students(model), "student_id", "n_exams") == [(2, 2), (3, 3), (4, 4)]
    rows = [r for r in rows if r.student < 4]
    assert got(activity.active_students(star_of(spark, rows)), "n_exams") == [(2,), (3,)]


def test_mean_grade_belongs_to_student_and_program(spark):
    rows = [
        Row("P", "e1", day(0), 1, 1, 30),
        Row("P", "e2", day(9), 1, 1, 30),
        Row("Q", "e1", day(0), 1, 0),
        Row("Q", "e2", day(4), 1, 0),
    ]
    columns = ("program_code", "avg_grade", "n_exams", "diff_day")
    assert got(activity.activity_profile(star_of(spark, rows)), *columns) == [
        ("P", 30.0, 2, 9.0),
        ("Q", 0.0, 2, 4.0),
    ]
    assert got(activity.activity_profile(wide_of(spark, rows)), *columns) == [
        ("P", 30.0, 2, 9.0),
        ("Q", None, 2, 4.0),
    ]


def test_score_without_any_period_is_null(spark):
    rows = [Row("P", "e1", day(0), s, 1, 28) for s in (1, 2)]
    for model in (star_of(spark, rows), wide_of(spark, rows)):
        found = got(activity.fast_furious(model), "diff_day_norm", "avg_grade_norm", "score")
        assert found == [(None, 1.0, None)] * 2


def test_score_weights(spark):
    rows = [
        Row("P", "e1", day(0), 1, 1, 30),
        Row("P", "e2", day(10), 1, 1, 30),
        Row("P", "e1", day(0), 2, 1, 24),
        Row("P", "e2", day(5), 2, 1, 24),
    ]
    found = got(activity.weighted_fast_furious(star_of(spark, rows), 0.25), "student_id", "score")
    assert found == [(1, 0.25), (2, 0.25 * 0.8 + 0.75 * 0.5)]
    with pytest.raises(ValueError):
        activity.weighted_fast_furious(star_of(spark, rows), 1.5)


def test_attempts_count_students_who_failed(spark):
    rows = [
        Row("P", "e1", day(0), 1, 0),
        Row("P", "e1", day(1), 1, 0),
        Row("P", "e1", day(0), 2, 0),
        Row("P", "e1", day(0), 3, 1, 20),
        Row("P", "e2", day(0), 3, 1, 20),
    ]
    for model in (star_of(spark, rows), wide_of(spark, rows)):
        assert got(attempts.trial_and_error(model), "exam_code", "attempts") == [("e1", 1.5)]


def test_exam_of_several_programs_shows_the_first_label(spark):
    rows = [Row("Q", "e1", day(0), 1, 0), Row("P", "e1", day(1), 1, 0), Row("P", "e1", day(2), 1, 0)]
    for model in (star_of(spark, rows), wide_of(spark, rows)):
        assert got(attempts.trial_and_error(model), "program", "attempts") == [(label("P"), 1.5)]


def test_pass_rate_without_passes(spark):
    rows = [Row("P", "e1", day(n), n, 0) for n in range(4)]
    columns = ("year", "n_enrolled", "n_passed", "ratio")
    assert got(pass_rate.exam_pass_rate(star_of(spark, rows)), *columns) == [("2018", 4, 0, 0.0)]
    assert got(pass_rate.exam_pass_rate(wide_of(spark, rows)), *columns) == [("18", 4, 0, 0.0)]


def band_rows():
    """Students per band 27, 28, 29+: P1 2/1/3, P2 0/4/1, P3 0/0/2, P4 1/0/0."""
    rows, student = [], 0
    for program, counts in {"P1": (2, 1, 3), "P2": (0, 4, 1), "P3": (0, 0, 2), "P4": (1, 0, 0)}.items():
        for grade, count in zip((27, 28, 30), counts):
            for _ in range(count):
                student += 1
                rows.append(Row(program, "e1", day(0), student, 1, grade))
        rows.append(Row(program, "e1", day(0), 100 + student, 1, 20))
    return rows


MERIT = ("program_code", "n27", "n28", "n29", "credits")


def test_merit_credits(spark):
    star, wide = star_of(spark, band_rows()), wide_of(spark, band_rows())
    common = [("P1", 2, 1, 3, 2000), ("P2", 4, None, 1, None)]
    assert got(merit.merit_credits(star), *MERIT) == common
    assert got(merit.merit_credits(wide), *MERIT) == common + [("P4", 1, None, None, None)]
    full = [("P1", 2, 1, 3, 2000), ("P2", 0, 4, 1, 1500), ("P3", 0, 0, 2, 1000), ("P4", 1, 0, 0, 125)]
    assert got(merit.merit_credits_full(star), *MERIT) == full
    assert got(merit.merit_credits_full(wide), *MERIT) == full


def test_bands_merge_by_position(spark):
    for model in (star_of(spark, band_rows()), wide_of(spark, band_rows())):
        found = got(merit.bands_27_28(model), "program_code", "n27", "n28")
        assert found == [("P1", 2, 1), ("P2", 4, None), ("P4", 1, None)]


def test_band_limits(spark):
    grades_of = {1: [27] * 99 + [26], 2: [27], 3: [28], 4: [29], 5: [30]}
    rows = [Row("P", f"e{n}", day(n), s, 1, g) for s, gs in grades_of.items() for n, g in enumerate(gs)]
    for model in (star_of(spark, rows), wide_of(spark, rows)):
        bands = [merit.students_in_band(model, *limits) for limits in merit.BANDS.values()]
        assert [got(b, "n") for b in bands] == [[(1,)], [(1,)], [(2,)]]


def test_short_label(spark):
    found = column(spark, ["x" * 65, "x" * 66, None]).select(short_label(F.col("v"))).collect()
    assert [r[0] for r in found] == ["x" * 65, "x" * 61 + "...", None]


def test_label_code_and_decimal_comma(spark):
    found = column(spark, ["[E1] A [b]", "no code"]).select(label_code(F.col("v"))).collect()
    assert [r[0] for r in found] == ["E1", ""]
    found = column(spark, [0.25, 1.0, 0.0], "double").select(decimal_comma(F.col("v"))).collect()
    assert [r[0] for r in found] == ["0,25", "1", "0"]


def rates_of(spark, count):
    rows = [(label(f"P{n:02}"), n, 20, n / 20) for n in range(count)]
    return spark.createDataFrame(rows, "program string, sum_commit bigint, sum_all bigint, commit_rate double")


def test_commitment_top_n_follows_the_selection(spark):
    rates = rates_of(spark, 20)
    twelve = [label(f"P{n:02}") for n in range(12)]
    found = got(commitment.commitment_top_n(rates, twelve), "program", sort=False)
    assert found == [(p,) for p in reversed(twelve[2:])]
    assert len(got(commitment.commitment_top_n(rates, twelve[:4]), "program")) == 4
    assert commitment.commitment_top_n(rates, []).count() == 0


def test_filter_programs_by_label_code_or_table(spark):
    rates = rates_of(spark, 5)
    expected = [(label("P01"),), (label("P03"),)]
    codes = spark.createDataFrame([("P01",), ("P03",), ("XX",)], "program_code string")
    for chosen in ([label("P01"), label("P03")], ["P01", "P03"], ["[P01] spelt otherwise", "P03"], codes):
        assert got(dashboard.filter_programs(rates, chosen), "program") == expected


def dimension_of(spark):
    rows = [
        ("P00", label("P00"), "Law ", "DEP A", "Degree", "English", 0),
        ("P01", label("P01"), "Law", "DEP A ", "Degree", None, 1),
        ("P02", label("P02"), "Art", "DEP B", "Degree", "English", 0),
    ]
    return spark.createDataFrame(
        rows,
        "program_code string, program string, area string, department string, "
        "degree_type string, language string, inactive int",
    )


def test_program_dimension(spark):
    dimension = dimension_of(spark)
    joined = dashboard.with_program_dimension(rates_of(spark, 4), dimension)
    assert joined.columns[-5:] == dashboard.ATTRIBUTES
    assert got(joined, "program", "area", "inactive")[2:] == [(label("P02"), "Art", 0), (label("P03"), None, None)]
    assert got(dashboard.filter_areas(rates_of(spark, 4), dimension, ["Art"]), "program") == [(label("P02"),)]
    assert got(dashboard.area_department(dimension), "area", "department", sort=False) == [
        ("Art", "DEP B"),
        ("Law", "DEP A"),
    ]


def test_top_k_of_small_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 9)], "g string, v int")
    assert got(top_k(df, ["g"], [F.desc("v")], 2), "g", "v") == [("a", 2), ("a", 3), ("b", 9)]


def test_questions_as_asked(spark):
    rows = [
        Row("P", "e1", day(0), 1, 0),
        Row("P", "e1", day(10), 1, 1, 30),
        Row("P", "e2", day(4), 1, 1, 20),
        Row("P", "e2", day(4), 2, 0),
        Row("P", "e1", day(0, 2019), 2, 1, 24),
    ]
    for model in (star_of(spark, rows), wide_of(spark, rows)):
        hardest = got(pass_rate.hardest_exams_overall(model, 1), "exam_code", "ratio")
        assert hardest == [("e1", 100.0), ("e1", 50.0)]
        per_day = got(activity.grade_per_active_day(model), "student_id", "avg_grade", "active_days", "ratio")
        assert per_day == [(1, 25.0, 10.0, 2.5), (2, 24.0, 361.0, 24.0 / 361.0)]
        assert got(attempts.trial_and_error_by_program(model), "program_code", "attempts") == [("P", 0.5)]


def test_academic_years_begin_in_october(spark):
    rows = [Row("P", "e1", datetime.date(2018, 9, 30), 1, 1), Row("P", "e1", datetime.date(2018, 10, 1), 2, 0)]
    rows += [Row("P", "e1", datetime.date(2019, 2, 1), 3, 1), Row("P", "e2", datetime.date(2019, 3, 1), 1, 0), Row("P", "e0", datetime.date(2019, 3, 1), 1, 0)]
    columns = ("academic_year", "exam_code", "n_enrolled", "n_passed", "ratio")
    for model in (star_of(spark, rows), wide_of(spark, rows)):
        assert got(pass_rate.hardest_exams_by_academic_year(model, 3), *columns) == [
            ("2017/2018", "e1", 1, 1, 100.0), ("2018/2019", "e0", 1, 0, 0.0), ("2018/2019", "e1", 2, 1, 50.0), ("2018/2019", "e2", 1, 0, 0.0),
        ]
        assert got(pass_rate.hardest_exams_by_academic_year(model, 1), *columns[:2]) == [("2017/2018", "e1"), ("2018/2019", "e0")]
        assert got(pass_rate.hardest_exams_by_academic_year(model, 3, first_month=9), *columns[:3])[0] == ("2018/2019", "e0", 1)
