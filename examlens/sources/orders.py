"""The exam model derived from the order tables (lineitem, orders, ...).

One enrolment per line item: the supplier's nation is the program, the part's brand
the exam, the customer the student. Foreign keys are assumed to hold, so a query
that does not read a table's columns skips the join with it.

The line items are joined with one base table after the other and no hints: each is
broadcast only while its file is below Spark's threshold, otherwise both sides are
shuffled and AQE splits the partitions of hot keys. (Joining supplier with nation
first would hide the sizes behind an estimate and could broadcast the line items.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import StarModel, WideModel

# Columns read from each table. A given schema saves Spark a job per table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_brand string",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_returnflag string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string",
}

# Sixteen years with their four leap days: moves 1995-2001 to 2011-2017, day by day.
SHIFT_DAYS = 16 * 365 + 4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def n_line_items(spark: SparkSession, sf_dir: str) -> int:
    """How many enrolments there are at most; Parquet tells it without reading rows."""
    return read(spark, sf_dir, "lineitem").count()


def _label(code: str, name: str) -> Column:
    return F.concat(F.lit("["), F.col(code), F.lit("] "), F.col(name))


def _program_code(nation_key: str) -> Column:
    return F.concat(F.lit("N"), F.lpad(F.col(nation_key).cast("string"), 2, "0"))


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "nation")
        .withColumn("program_code", _program_code("n_nationkey"))
        .withColumn("program", _label("program_code", "n_name"))
    )


def _line_items(
    spark: SparkSession, sf_dir: str, *, student: bool, exam: bool, program: bool
) -> DataFrame:
    """Line items with nation key and day; student, exam and program if asked for.

    Keys first, texts last: what passes the shuffles of large tables are numbers.
    """
    graded = (F.col("l_returnflag") != "R") & (F.col("l_linenumber") != 7)
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.date_add(F.col("l_shipdate").cast("date"), SHIFT_DAYS).alias("day"),
        (F.col("l_returnflag") != "R").cast("int").alias("passed"),
        F.when(graded, F.col("l_quantity").cast("int") % 13 + 18).alias("grade"),
    )
    if student:
        buyers = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "student_id")
        rows = rows.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if exam:
        parts = (
            read(spark, sf_dir, "part")
            .withColumnRenamed("p_brand", "exam_code")
            .withColumn("exam", _label("exam_code", "exam_code"))
        )
        rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    if program:
        labels = _programs(spark, sf_dir).select("n_nationkey", "program_code", "program")
        return rows.join(labels, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.withColumn("program_code", _program_code("s_nationkey"))


def _session_id() -> Column:
    day = (F.year("day") * 10000 + F.month("day") * 100 + F.dayofmonth("day")).cast("string")
    return F.concat_ws("-", "program_code", "exam_code", day).alias("session_id")


def star(spark: SparkSession, sf_dir: str, *, student: bool = True) -> StarModel:
    """The four normalised tables; `student_id` only where asked for."""
    items = _line_items(spark, sf_dir, student=student, exam=True, program=False)
    held = _line_items(spark, sf_dir, student=False, exam=True, program=False)
    days = held.select("s_nationkey", "exam_code", "day").distinct()
    days = days.withColumn("program_code", _program_code("s_nationkey"))
    date_text = F.concat_ws("/", F.dayofmonth("day"), F.month("day"), F.year("day"))
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("exam_code")).distinct()
    return StarModel(
        program=_programs(spark, sf_dir).select("program_code", "program"),
        exam=brands.withColumn("exam", _label("exam_code", "exam_code")),
        session=days.select(_session_id(), "program_code", "exam_code", date_text.alias("session_date")),
        enrolment=items.select(_session_id(), *(["student_id"] if student else []), "passed", "grade"),
    )


def wide(spark: SparkSession, sf_dir: str, *, student: bool = True, exam: bool = True) -> WideModel:
    """The wide table; student and exam columns only where asked for."""
    items = _line_items(spark, sf_dir, student=student, exam=exam, program=True)
    columns = ["program_code", "program", F.date_format("day", "dd/MM/yy").alias("session_date")]
    if exam:
        columns += ["exam_code", "exam"]
    if student:
        columns += ["student_id"]
    return WideModel(items.select(*columns, "passed", "grade"))


def program_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region as area."""
    regions = read(spark, sf_dir, "region")
    return (
        _programs(spark, sf_dir)
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "program_code",
            "program",
            F.col("r_name").alias("area"),
            F.col("n_name").alias("department"),
            F.lit("Degree").alias("degree_type"),
            F.lit("English").alias("language"),
            F.lit(0).alias("inactive"),
        )
    )
