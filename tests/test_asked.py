"""Distributions, exports, arrays of records and SQL of the session, against plain Python and by their plans."""

import csv as plain_csv
import datetime
import glob
import io
import json
import random
import re

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from examlens.functions.dates import parse_dmy
from examlens.functions.text import decimal_comma, label_code, short_label
from examlens.operators import activity, distributions
from examlens.plans import refresh
from examlens.session import scratch_path
from examlens.sources import dimension, export, sql, views
from mini import Row, day, got, star_of
from test_brute_force import random_rows
from test_plans import QUERIES, plan


def plain_quantiles(values, parts, wanted):
    held = sorted(v for v in values if v is not None)
    return {p: held[max(1, -(-len(held) * p // parts)) - 1] for p in wanted} if held else {}


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_quantiles_of_uneven_groups(spark, buckets):
    rnd = random.Random(buckets)
    groups = {"hot": [rnd.choice([0.0, 0.5, rnd.random()]) for _ in range(3000)], "one": [3.5], "same": [2.0] * 50}
    groups |= {"none": [None] * 4, None: [rnd.gauss(0, 1e6) for _ in range(37)], "far": [1e300, -1e300, *[rnd.random() for _ in range(99)]]}
    groups |= {f"g{i}": [rnd.choice([None, rnd.random()]) for _ in range(i)] for i in range(1, 30)}
    rows = [(g, v) for g, held in groups.items() for v in held]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    found = {}
    for r in distributions.grouped_quantiles(df, ["g"], "v", 10, (1, 5, 9, 10), buckets).collect():
        found.setdefault(r["g"], {})[r["part"]] = r["v"]
        assert r["n"] == sum(v is not None for v in groups[r["g"]])
    assert found == {g: q for g, held in groups.items() if (q := plain_quantiles(held, 10, (1, 5, 9, 10)))}
    assert distributions.grouped_quantiles(df.limit(0), ["g"], "v", 4, (1,)).collect() == []


def test_quantiles_bring_no_group_into_one_task(spark, sf_dir):
    text = plan(QUERIES["fast_furious_deciles"](spark, sf_dir))
    # What is sorted in a window are counts of ranges or of different values.
    for window in re.findall(r"Window \[[^\n]*\n(?:[^\n]*\n){1,4}", text):
        assert "score" not in window.splitlines()[0].split("windowspecdefinition")[-1] or "_v" in window
    assert "collect_list" not in text and "percentile" not in text


def hot_students():
    """A third of all students in one program, some with equal scores."""
    rows = []
    for s in range(900):
        program = "P0" if s % 3 == 0 else f"P{1 + s % 5}"
        rows += [Row(program, f"e{j}", day((s * 7 + j * (s % 11)) % 200), s, 1, 18 + (s + j) % 13) for j in range(1 + s % 4)]
    return rows


@pytest.mark.parametrize("k", [1, 3, 500])
def test_the_best_for_every_weight(spark, k):
    model = star_of(spark, hot_students())
    scored = activity.fast_furious(model).collect()
    expected = []
    for i in range(101):
        w = i / 100
        for program in {r["program_code"] for r in scored}:
            mine = [r for r in scored if r["program_code"] == program and r["score"] is not None]
            ranked = sorted(
                ((-(w * r["avg_grade_norm"] + (1.0 - w) * ((1.0 - r["diff_day_norm"]) * r["n_exams_norm"])), r["student_id"]) for r in mine)
            )
            expected += [(program, w, n, s, -v) for n, (v, s) in enumerate(ranked[:k], 1)]
    model = type(model)(model.program, model.exam, model.session, model.enrolment.repartition(6))
    found = got(distributions.fast_furious_by_weight(model, k), "program_code", "weight", "rank", "student_id", "score")
    assert found == sorted(expected, key=repr)


def test_leaders_keep_few_students():
    rnd = np.random.default_rng(1)
    leaders = distributions.Leaders(3, np.dtype(np.int64))
    for at in range(0, 50_000, 1000):
        leaders.add(np.arange(at, at + 1000), rnd.random(1000), rnd.random(1000))
        assert len(leaders.student) <= 3 * 101
    assert len(leaders.student) < 60


def test_weights_are_laid_out_after_the_shuffle(spark, sf_dir):
    final = plan(QUERIES["fast_furious_by_weight"](spark, sf_dir), executed=True).split("Initial Plan")[0]
    above, below = final.split("MapInArrow", 1)
    assert "Generate" in above and "Generate" not in below
    assert len(re.findall(r"Exchange hashpartitioning", above)) == 1


def plain_file(columns, rows):
    out = io.StringIO()
    writer = plain_csv.writer(out, lineterminator="\r\n")
    writer.writerow(columns)
    writer.writerows(rows)
    return out.getvalue().encode()


def concatenated(path):
    return b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{path}/part-*")))


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_parts_are_one_file_byte_for_byte(spark, tasks, conf):
    conf("spark.sql.shuffle.partitions", str(tasks))
    conf("spark.sql.adaptive.enabled", "false")
    rows = [(n, f'x,"{n}"' if n % 3 else f"plain {n}", None if n % 5 == 0 else n / 4, "a\r\nb" if n == 7 else "é") for n in range(500)]
    df = spark.createDataFrame(rows, 'id int, `a "b"` string, d double, t string').repartition(8)
    path = scratch_path(spark, "export")
    export.export_csv(df, path, [F.desc("id")])
    texts = [(str(i), t, "" if d is None else str(d), x) for i, t, d, x in sorted(rows, reverse=True)]
    assert concatenated(path) == plain_file(df.columns, texts)
    if tasks == 40:
        assert len(glob.glob(f"{path}/part-*")) > 10
    with pytest.raises(PySparkException):
        export.export_csv(df, path, ["id"])
    export.export_csv(df.limit(0), path, ["id"], overwrite=True)
    assert concatenated(path) == plain_file(df.columns, [])


def test_exports_read_back(spark):
    df = spark.createDataFrame([(1, "[P] a, b", 2.5, datetime.date(2018, 2, 1)), (2, None, None, None)], "n int, t string, d double, day date")
    path = scratch_path(spark, "export")
    export.export_csv(df, path, ["n"])
    assert got(export.read_export(spark, path, df.schema), *df.columns) == got(df, *df.columns)


ARRAY = """
/* programs */ $scope.cds =  [
    { "cds": "[P1] A", Area: 'Law', "Nome": "A",
      "Dipartimento": "DEP ", 'tipo': "Degree  ", Lingua: null, disattivato: 1, },
    {cds: "[P2] B's \\"x\\", y: z", Area: "Art", Nome: "B", Dipartimento: "DEP", tipo: "Degree", Lingua: "Italian", disattivato: 0}, {
      cds: "[P3] C" }
];
$scope.areas = [];
"""
DIMENSION = ("program_code", "program", "area", "department", "degree_type", "language", "inactive")


def test_one_array_of_records(spark, tmp_path):
    (tmp_path / "array.js").write_text(ARRAY)
    found = got(dimension.read_program_array(spark, str(tmp_path / "array.js")), *DIMENSION)
    assert found == [
        ("P1", "[P1] A", "Law", "DEP", "Degree", None, 1),
        ("P2", "[P2] B's \"x\", y: z", "Art", "DEP", "Degree", "Italian", 0),
        ("P3", "[P3] C", None, None, None, None, None),
    ]
    (tmp_path / "none.js").write_text("var x = [];")
    assert dimension.read_program_array(spark, str(tmp_path / "none.js")).collect() == []
    (tmp_path / "braces.js").write_text('[{cds: "[P1] a } b", Area: "x"}]')
    with pytest.raises((PySparkException, Py4JJavaError)):
        dimension.read_program_array(spark, str(tmp_path / "braces.js")).collect()


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path, conf):
    conf("spark.sql.files.maxPartitionBytes", "20000")
    conf("spark.sql.files.openCostInBytes", "1")
    records = [{"cds": f"[P{n}] NAME {n}", "Area": f"A{n % 7}", "Nome": "x" * (n % 90), "Dipartimento": "D", "tipo": "T", "Lingua": "L", "disattivato": n % 2} for n in range(3000)]
    (tmp_path / "array.json").write_text(json.dumps(records, indent=1))
    found = dimension.read_program_array(spark, str(tmp_path / "array.json"))
    assert found.rdd.getNumPartitions() > 10
    assert got(found, "program_code", "area", "inactive") == sorted([(f"P{r['cds'][2:].split(']')[0]}", r["Area"], r["disattivato"]) for r in records], key=repr)
    path = scratch_path(spark, "array")
    dimension.write_program_array(found, path)
    again = dimension.read_program_array(spark, path)
    assert got(again, *DIMENSION) == got(found, *DIMENSION)


@pytest.fixture
def registered(spark):
    derived = refresh.refresh(star_of(spark, random_rows(3, True)))
    views.register_tables(spark, derived.model)
    refresh.register_reports(derived)
    sql.register_functions(spark)
    return derived


@pytest.mark.parametrize("name", ["top_exams", "hardest_exams"])
def test_correlated_subqueries_rank_by_an_explicit_order(spark, registered, name):
    report = {"top_exams": "best_exams"}.get(name, name)
    found, expected = sql.STATEMENTS[name].run(spark), refresh.ANSWERS[report](registered)
    assert got(found, *expected.columns) == got(expected, *expected.columns)
    text = plan(found, executed=True)
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert re.search(r"row_number\(\) windowspecdefinition\(program_code#\d+, (mean_grade#\d+ DESC|year#\d+ ASC)", text)
    assert "WindowGroupLimit" in text


def test_parameters_are_checked_and_never_text(spark, registered):
    top = sql.STATEMENTS["commitment_top_n"]
    rates = refresh.ANSWERS["commitment_rate"](registered).collect()
    known = [r["program"] for r in rates]
    assert len(top.run(spark, programs=known, limit=2).collect()) == 2
    assert top.run(spark, programs=["x' OR 1 = 1 --"], limit=5).collect() == []
    assert top.run(spark, programs=known, limit=0).collect() == []
    scored = sql.STATEMENTS["weighted_fast_furious"]
    for weight in (0, 0.3, 1):
        expected = activity.weighted_fast_furious(registered.model, weight)
        assert got(scored.run(spark, weight=weight), *expected.columns) == got(expected, *expected.columns)
    bad = [(scored, {"weight": w}) for w in (-0.01, 1.5, "0.5", None, True, float("nan"))]
    bad += [(top, {"programs": "x", "limit": 1}), (top, {"programs": [1], "limit": 1}), (top, {"programs": [], "limit": -1}), (top, {"limit": 1}), (scored, {"weight": 0.5, "limit": 1})]
    for statement, values in bad:
        with pytest.raises(ValueError):
            statement.run(spark, **values)


def test_functions_are_those_of_the_library(spark):
    sql.register_functions(spark)
    sql.register_functions(spark)
    rows = [("[P1] " + "x" * 60, 2.5, "1/2/2018"), ("[P1] " + "x" * 61, 3.0, "31/2/2018"), ("none", -0.25, "x"), (None, None, None), ("é" * 70, 1e-7, "12/11/2018")]
    df = spark.createDataFrame(rows, "label string, number double, text string")
    df.createOrReplaceTempView("function_rows")
    found = spark.sql("SELECT short_label(label) a, label_code(label) b, decimal_comma(number) c, parse_dmy(text) d, days_between(parse_dmy(text), parse_dmy2('01/01/18')) e FROM function_rows")
    expected = df.select(short_label(F.col("label")), label_code(F.col("label")), decimal_comma(F.col("number")), parse_dmy(F.col("text")))
    assert [tuple(r)[:4] for r in found.collect()] == [tuple(r) for r in expected.collect()]
    assert [r["e"] for r in found.collect()] == [31.0, None, None, None, 315.0]
    assert "Python" not in plan(found)


