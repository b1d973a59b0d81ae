"""CSV results: header, RFC 4180 quoting, CRLF line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

# Fixed values of the format; blanks inside cells are data.
FORMAT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(
    df: DataFrame, path: str, order: list[Column | str] | None = None, *, overwrite: bool = False
) -> None:
    """Write a folder of CSV files, in order from file to file if one is given.

    The sort is distributed by range. Give an order without equal rows (end it with
    the key columns), or equal rows gather in one task. An earlier export at `path`
    stops the writing unless it is to be overwritten.
    """
    if order:
        df = df.orderBy(*order)
    df.write.mode("overwrite" if overwrite else "errorifexists").options(lineSep="\r\n", **FORMAT).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read results with any line ends; an empty cell is NULL, quoted or not."""
    return spark.read.options(**FORMAT).schema(schema).csv(path)
