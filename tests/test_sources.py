"""Readers, writers and temporary tables."""

import glob
import json

import pytest

from examlens.operators import grades, merit
from examlens.plans.reports import REPORTS, choose_programs, write_reports
from examlens.session import scratch_path, shared_folder
from examlens.sources import csv, dimension, tables, views
from mini import Row, day, dmy, dmy2, got, label, session_id, star_of, wide_of

ROWS = [Row(f"P{n % 3}", f"e{n % 5}", day(n), n % 7, n % 4 and 1, 18 + n % 13 if n % 4 else None) for n in range(90)]


def read_text(path):
    (part,) = glob.glob(f"{path}/part-*")
    with open(part, newline="") as file:
        return file.read()


def test_csv_cells(spark):
    path = scratch_path(spark, "cells")
    df = spark.createDataFrame(
        [('x,"y"', 1, 0.1), (" padded ", None, 2.5), (None, 3, None), ("", 4, 1.0)], "t string, n int, d double"
    )
    csv.write_csv(df.coalesce(1), path)
    assert read_text(path) == 't,n,d\r\n"x,""y""",1,0.1\r\n padded ,,2.5\r\n,3,\r\n"",4,1.0\r\n'
    read = got(csv.read_csv(spark, path, df.schema), "t", "n", "d")
    assert read == got(df.replace("", None), "t", "n", "d")


def test_csv_with_plain_line_ends(spark, tmp_path):
    (tmp_path / "result.csv").write_text('program,n\n"[P1] A, ""B""",3\n[P2] C,\n')
    df = csv.read_csv(spark, str(tmp_path / "result.csv"), spark.createDataFrame([], "program string, n int").schema)
    assert got(df, "program", "n", sort=False) == [('[P1] A, "B"', 3), ("[P2] C", None)]


def test_reports_are_written_in_order(spark):
    model = star_of(spark, ROWS)
    folder = scratch_path(spark, "reports")
    write_reports(model, folder)
    for name, report in REPORTS.items():
        expected = report.build(model)
        found = csv.read_csv(spark, f"{folder}/{name}", expected.schema)
        assert got(found, *expected.columns) == got(expected, *expected.columns), name
    means = got(
        csv.read_csv(spark, f"{folder}/best_exams", grades.best_exams(model).schema).coalesce(1),
        "program_code",
        "mean_grade",
        sort=False,
    )
    assert means == sorted(means, key=lambda r: (r[0], -r[1]))


def test_a_new_choice_replaces_the_old_one(spark):
    model = star_of(spark, ROWS)
    results = {name: report.build(model) for name, report in REPORTS.items()}
    first = choose_programs(results, [label("P0")])
    second = choose_programs(results, [label("P1"), label("P2")])
    for name in results:
        assert {r[0] for r in got(first[name], "program")} <= {label("P0")}
        assert {r[0] for r in got(second[name], "program")} <= {label("P1"), label("P2")}
    assert len(got(second["commitment_rate"], "program")) == 2


def test_program_dimension_records(spark, tmp_path):
    records = [
        {
            "cds": "[P1] A",
            "Area": "Law",
            "Nome": "A",
            "Dipartimento": "DEP ",
            "tipo": "Degree  ",
            "Lingua": None,
            "disattivato": 1,
        },
        {
            "cds": "[P2] B",
            "Area": "Art",
            "Nome": "B",
            "Dipartimento": "DEP",
            "tipo": "Degree",
            "Lingua": "Italian",
            "disattivato": 0,
        },
    ]
    (tmp_path / "array.json").write_text(json.dumps(records, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, records)))
    columns = ("program_code", "program", "area", "department", "degree_type", "language", "inactive")
    expected = [
        ("P1", "[P1] A", "Law", "DEP", "Degree", None, 1),
        ("P2", "[P2] B", "Art", "DEP", "Degree", "Italian", 0),
    ]
    for name, array in (("array", True), ("lines", False)):
        found = dimension.read_program_dimension(spark, str(tmp_path / f"{name}.json"), array)
        assert got(found, *columns) == expected
    path = scratch_path(spark, "dimension")
    dimension.write_program_dimension(found, path)
    assert got(dimension.read_program_dimension(spark, path), *columns) == expected


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_stored_tables_under_original_names(spark, fmt):
    root = scratch_path(spark, "tables")
    held = sorted({(r.program, r.exam, r.day) for r in ROWS})
    stored = {
        "cds": (sorted({(p, label(p)) for p, _, _ in held}), "cdscod string, cds string"),
        "ad": (sorted({(e, label(e)) for _, e, _ in held}), "adcod string, ad string"),
        "appelli": (
            [(session_id(p, e, d), p, e, dmy(d)) for p, e, d in held],
            "appcod string, cdscod string, adcod string, dtappello string",
        ),
        "iscrizioni": (
            [(session_id(r.program, r.exam, r.day), r.student, r.passed, r.grade) for r in ROWS],
            "appcod string, Studente bigint, Superamento bigint, Voto bigint",
        ),
        "wide": (
            [
                (r.program, label(r.program), r.exam, label(r.exam), dmy2(r.day), r.student, r.passed, r.grade)
                for r in ROWS
            ],
            "CdSCod string, CdS string, AdCod string, AD string, DtAppello string, "
            "Studente bigint, Superamento bigint, Voto bigint",
        ),
    }
    for name, (rows, schema) in stored.items():
        df = spark.createDataFrame(rows, schema)
        if fmt == "csv":
            csv.write_csv(df, f"{root}/{name}")
        else:
            df.write.parquet(f"{root}/{name}")
    star, wide = tables.read_star(spark, root, fmt), tables.read_wide(spark, f"{root}/wide", fmt)
    for operator in (grades.best_exams, merit.merit_credits_full):
        expected = operator(star_of(spark, ROWS))
        for model in (star, wide):
            assert got(operator(model), *expected.columns) == got(expected, *expected.columns)


def test_temporary_tables(spark):
    star, wide = star_of(spark, ROWS), wide_of(spark, ROWS)
    views.register_tables(spark, star)
    views.register_tables(spark, wide)
    views.register_derived(spark, star)
    joined = spark.sql(
        """
        SELECT s.program_code, count(*) AS n
        FROM enrolment e JOIN session s ON s.session_id = e.session_id
        JOIN program p ON p.program_code = s.program_code JOIN exam x ON x.exam_code = s.exam_code
        GROUP BY s.program_code
        """
    )
    flat = spark.sql("SELECT program_code, count(*) AS n FROM enrolment_wide GROUP BY program_code")
    assert got(joined, "program_code", "n") == got(flat, "program_code", "n")
    for name in ("exam_pass_rate", "student_activity", "activity_profile", "students_in_band_27", "bands_27_28"):
        assert spark.catalog.tableExists(name)
    kept = views.temp_table(spark, "means", grades.exam_mean_grade(star), materialise=True)
    assert "Scan ExistingRDD" in kept._jdf.queryExecution().executedPlan().toString()
    views.temp_table(spark, "means", kept.filter("program_code = 'P0'"))
    assert spark.table("means").select("program_code").distinct().count() == 1


class FakeSession:
    """What `shared_folder` reads of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})()
        self.folder = folder
        self.conf = self

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.folder or default

    def set(self, key, value):
        self.folder = value


def test_shared_folder_is_the_one_of_the_cluster(spark):
    assert scratch_path(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    assert shared_folder(FakeSession("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            shared_folder(FakeSession(master))
    local = FakeSession("local[2]")
    assert shared_folder(local) == shared_folder(local) == local.folder
