"""The program dimension as JSON records."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import label_code

# Field names of the records and the columns they become.
FIELDS = {
    "cds": "program",
    "Area": "area",
    "Nome": "name",
    "Dipartimento": "department",
    "tipo": "degree_type",
    "Lingua": "language",
    "disattivato": "inactive",
}
RECORD = StructType(
    [StructField(f, IntegerType() if f == "disattivato" else StringType()) for f in FIELDS]
)


def read_program_dimension(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """One record per line, or with `array` a JSON array of them.

    The code comes from the label; trailing blanks of the texts are dropped.
    """
    return _named(spark.read.schema(RECORD).json(path, multiLine=array))


def _named(records: DataFrame) -> DataFrame:
    texts = [
        (F.col(f) if f in ("cds", "disattivato") else F.rtrim(f)).alias(name) for f, name in FIELDS.items()
    ]
    return records.select(label_code(F.col("cds")).alias("program_code"), *texts)


def write_program_dimension(dimension: DataFrame, path: str) -> None:
    """The inverse of `read_program_dimension`, one record per line.

    A dimension without `name` column gets the label's text after the code.
    """
    if "name" not in dimension.columns:
        dimension = dimension.withColumn("name", F.regexp_replace("program", r"^\[[^\]]+\]\s*", ""))
    dimension.select(*[F.col(name).alias(f) for f, name in FIELDS.items()]).write.json(path)


# As scripts write records: names without quotes, either kind of quotes, comments.
LENIENT = {
    "mode": "FAILFAST",
    "allowUnquotedFieldNames": "true",
    "allowSingleQuotes": "true",
    "allowComments": "true",
    "allowBackslashEscapingAnyCharacter": "true",
}


def read_program_array(spark: SparkSession, path: str) -> DataFrame:
    """The dimension from one array of records in a script, in any layout.

    The text is cut behind every closing brace, which Spark does across splits: a large
    array is read by many tasks. What stands between the records (brackets, commas, the
    name of the array) is skipped, a comma behind the last field is allowed. Texts with
    braces fail the query: they would be cut in two.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    inside = F.regexp_extract("value", r"(?s)\{(.*)$", 1)
    cut = pieces.where(F.contains("value", F.lit("{"))).select(F.regexp_replace(inside, r",\s*$", "").alias("fields"))
    record = F.from_json(F.concat(F.lit("{"), "fields", F.lit("}")), RECORD, LENIENT)
    return _named(cut.select(record.alias("r")).select("r.*"))


def write_program_array(dimension: DataFrame, path: str, name: str = "programs") -> None:
    """The inverse of `read_program_array`: a script that names one array, a record a line, by code."""
    if "name" not in dimension.columns:
        dimension = dimension.withColumn("name", F.regexp_replace("program", r"^\[[^\]]+\]\s*", ""))
    value = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    fields = [F.concat(F.lit(f"{f}: "), value(name)) for f, name in FIELDS.items()]
    line = F.concat(F.lit("  {"), F.concat_ws(", ", *fields), F.lit("},"))
    ends = dimension.sparkSession.createDataFrame([(0, f"var {name} = ["), (2, "];")], "part int, value string")
    rows = dimension.select(F.lit(1).alias("part"), line.alias("value")).unionByName(ends)
    rows.orderBy("part", "value").select("value").write.text(path)
