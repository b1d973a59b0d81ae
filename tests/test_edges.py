"""Edge semantics of grades: what is stored, what is missing, what cannot be placed."""

import pytest
from pyspark.errors import NumberFormatException

from examlens.operators import activity, grades
from examlens.operators.dashboard import filter_programs
from examlens.operators.model import StarModel
from examlens.sources import csv, tables

WIDE = "CdSCod string, CdS string, AdCod string, AD string, DtAppello string, Studente bigint, Superamento int, Voto string"


def stored_wide(spark, tmp_path, rows):
    path = str(tmp_path / "wide")
    spark.createDataFrame(rows, WIDE).write.parquet(path)
    return tables.read_wide(spark, path)


def row(exam, grade, program="P", student=1):
    return (program, f"[{program}] X", exam, f"[{exam}] Y", "01/02/18", student, 1, grade)


def test_fractional_grades_are_averaged_as_stored(spark, tmp_path):
    model = stored_wide(spark, tmp_path, [row("e1", "28.5"), row("e1", "29")])
    assert grades.exam_mean_grade(model).first()["mean_grade"] == 28.75


def test_an_unreadable_grade_fails(spark, tmp_path):
    model = stored_wide(spark, tmp_path, [row("e1", "30L")])
    with pytest.raises(NumberFormatException):
        grades.exam_mean_grade(model).collect()


def test_wide_exams_without_grades_keep_a_null_mean_but_are_not_ranked(spark, tmp_path):
    model = stored_wide(spark, tmp_path, [row("e1", None), row("e2", "30")])
    means = {r["exam_code"]: r["mean_grade"] for r in grades.exam_mean_grade(model).collect()}
    assert means == {"e1": None, "e2": 30.0}
    assert [r["exam_code"] for r in grades.worst_exams(model).collect()] == ["e2"]


def test_null_codes_are_not_ranked(spark, tmp_path):
    model = stored_wide(spark, tmp_path, [row("e1", "30"), row(None, "30"), row("e1", "30", program=None)])
    found = [(r["program_code"], r["exam_code"]) for r in grades.best_exams(model).collect()]
    assert found == [("P", "e1")]


def test_grades_in_unlisted_exams_do_not_count(spark):
    model = StarModel(
        program=spark.createDataFrame([("P", "[P] X")], "program_code string, program string"),
        exam=spark.createDataFrame([("e1", "[e1] Y")], "exam_code string, exam string"),
        session=spark.createDataFrame(
            [("s1", "P", "e1", "1/2/2018"), ("s2", "P", "e2", "2/2/2018")],
            "session_id string, program_code string, exam_code string, session_date string",
        ),
        enrolment=spark.createDataFrame(
            [("s1", 1, 1, 30), ("s2", 1, 1, 18)], "session_id string, student_id bigint, passed int, grade int"
        ),
    )
    (profile,) = activity.activity_profile(model).collect()
    assert (profile["avg_grade"], profile["n_exams"]) == (30.0, 2)


def test_a_label_without_its_bracket_is_plain_text(spark):
    result = spark.createDataFrame([("[P",), ("P",)], "program_code string")
    assert [r[0] for r in filter_programs(result, ["[P"]).collect()] == ["[P"]
    assert filter_programs(result, []).collect() == []


def test_an_export_is_replaced_only_on_request(spark, tmp_path):
    path = str(tmp_path / "out")
    csv.write_csv(spark.range(3), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        csv.write_csv(spark.range(2), path)
    csv.write_csv(spark.range(2), path, overwrite=True)
    assert csv.read_csv(spark, path, spark.range(1).schema).count() == 2
