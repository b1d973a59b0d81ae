"""Physical plans: what is scanned, shuffled and broadcast, and what skew does to them."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from examlens.operators import activity, grades
from examlens.session import shuffle_partitions
from examlens.sources import orders
from mini import Row, day, star_of

QUERIES = entry_module.queries()


def plan(df, executed=False):
    if executed:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, table_prefix):
    """Schemas read by the scans of one table in the initial plan, without reused ones."""
    return re.findall(rf"FileScan parquet \[({table_prefix}_[^\]]*)\]", plan(df))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_products(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["exam_pass_rate_wide", "merit_credits_wide", "session_enrolments_wide"])
def test_wide_operators_scan_the_facts_once(spark, sf_dir, name):
    assert len(scans(QUERIES[name](spark, sf_dir), "l")) == 1


def test_unused_tables_are_not_joined(spark, sf_dir):
    rates = QUERIES["exam_pass_rate_wide"](spark, sf_dir)
    assert not scans(rates, "o")
    bands = QUERIES["merit_credits_wide"](spark, sf_dir)
    assert not scans(bands, "p")


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["mean_attempts_wide"](spark, sf_dir))
    (pushed,) = re.findall(r"PushedFilters: \[([^\]]*l_returnflag[^\]]*)\]", text)
    assert "EqualTo(l_returnflag,R)" in pushed
    (columns,) = scans(QUERIES["commitment_rate"](spark, sf_dir), "l")
    assert {c.split("#")[0] for c in columns.split(",")} == {"l_partkey", "l_suppkey", "l_shipdate"}


@pytest.mark.parametrize("name", ["best_exams", "worst_exams", "hardest_exams"])
def test_top_k_is_cut_before_the_shuffle(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert re.search(r"WindowGroupLimit .* Partial", text)
    assert re.search(r"WindowGroupLimit .* Final", text)


def test_global_top_k_does_not_sort_everything(spark, sf_dir):
    for name in ("trial_and_error", "commitment_top_n"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir))


def test_line_items_are_never_broadcast(spark, sf_dir):
    """The dimension side is the one to broadcast, also where estimates are off."""
    text = plan(QUERIES["best_exams_wide"](spark, sf_dir))
    assert "BuildLeft" not in text


@pytest.mark.parametrize("layout", ["star", "wide"])
@pytest.mark.parametrize("operator", [activity.active_students, activity.activity_profile, activity.fast_furious])
def test_median_and_rows_share_one_grouping(spark, sf_dir, layout, operator):
    model = orders.star(spark, sf_dir) if layout == "star" else orders.wide(spark, sf_dir, exam=False)
    final = plan(operator(model), executed=True)
    assert re.search(r"ReusedExchange \[student_id", final)


def test_top_exams_read_the_rates_once(spark, sf_dir):
    final = plan(QUERIES["hardest_exams_wide"](spark, sf_dir), executed=True)
    assert re.search(r"ReusedExchange \[program_code", final)


def hot_rows():
    """A third of all enrolments in one session, and a third from one student."""
    rows = [Row("P0", "e0", day(0), s, 1, 18 + s % 13) for s in range(3000)]
    rows += [Row(f"P{n % 7}", f"e{n % 11}", day(n % 300), 7, n % 2, 20) for n in range(3000)]
    return rows + [Row(f"P{n % 7}", f"e{n % 11}", day(n % 299), n % 500, n % 3 % 2, 25) for n in range(3000)]


def test_hot_session_is_split(spark, conf):
    rows = hot_rows()
    model = star_of(spark, rows)
    # Several map tasks, as a large table has, give AQE something to split.
    model = type(model)(model.program, model.exam, model.session, model.enrolment.repartition(16, F.rand(1)))
    expected = sorted(map(tuple, activity.student_activity(model).collect()))
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "4k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    conf("spark.sql.shuffle.partitions", "16")
    df = activity.student_activity(model)
    final = plan(df, executed=True)
    assert "skew=true" in final
    assert sorted(map(tuple, df.collect())) == expected


def test_hot_session_is_summed_before_the_join(spark):
    """Each map task sends one row per session, whatever a session's share is."""
    model = star_of(spark, hot_rows())
    text = plan(grades.exam_mean_grade(model))
    below_join = text[text.index("SortMergeJoin" if "SortMergeJoin" in text else "HashJoin") :]
    assert re.search(r"keys=\[session_id#\d+\], functions=\[partial_sum", below_join)


def test_shuffle_partitions_follow_the_input():
    assert shuffle_partitions(0, 8) == 8
    assert shuffle_partitions(100 * 2**40, 4000) == 819_200
    assert shuffle_partitions(2**30, 4) == 8


def test_a_selection_keeps_the_shared_grouping(spark, sf_dir):
    whole = scans(QUERIES["fast_furious"](spark, sf_dir), "l")
    assert len(scans(QUERIES["chosen_fast_furious"](spark, sf_dir), "l")) == len(whole)


@pytest.mark.parametrize("name", ["session_dates", "session_dates_wide"])
def test_session_dates_scan_the_facts_once(spark, sf_dir, name):
    assert len(scans(QUERIES[name](spark, sf_dir), "l")) == 1


def test_a_configured_number_of_partitions_is_not_lowered(spark):
    from examlens.session import build_session

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20000")
    try:
        build_session("tests")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "20000"
        build_session("tests", input_bytes=1 << 30)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "20000"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["session_enrolments", "exam_pass_rate", "best_exams", "trial_and_error", "with_program_dimension"])
def test_star_operators_scan_the_line_items_once(spark, sf_dir, name):
    """Their sessions are stored once and read from there."""
    assert len(scans(QUERIES[name](spark, sf_dir), "l")) == 1


@pytest.mark.parametrize("name", ["hardest_exams", "fast_furious", "merit_credits", "chosen_fast_furious"])
def test_shared_groupings_scan_the_line_items_once(spark, sf_dir, name):
    final = plan(QUERIES[name](spark, sf_dir), executed=True).split("Initial Plan")[0]
    assert len(re.findall(r"FileScan parquet \[l_", final)) == 1
