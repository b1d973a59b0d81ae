"""A result as one CSV file in parts: their concatenation in the order of their names is the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .csv import FORMAT

LINE_END = "\r\n"  # fixed value of the format


def csv_line(df: DataFrame) -> Column:
    """A row as a line of the file, in the same quoting as `write_csv`."""
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in FORMAT.items() if k != "header"}
    columns = [F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    return F.to_csv(F.struct(*columns), options)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if set(name) & set(',"\r\n') or name != name.strip() else name


def export_csv(df: DataFrame, path: str, order: list[Column | str], *, overwrite: bool = False) -> None:
    """Write ordered parts of which the first begins with the header and no other has one.

    The header is a row of its own that sorts before all others, so one distributed sort
    by range puts it at the beginning of the first part. Give an order without equal
    rows, or equal rows gather in one task. An empty result is the header alone.
    """
    header = ",".join(map(_quoted, df.columns))
    keys = [F.col(c).asc() if isinstance(c, str) else c for c in order]
    lines = df.withColumns({"_line": csv_line(df), "_body": F.lit(1)})
    first = df.sparkSession.range(1).select(F.lit(header).alias("_line"), F.lit(0).alias("_body"))
    both = lines.unionByName(first, allowMissingColumns=True)
    ordered = both.orderBy("_body", *keys).select("_line")
    mode = "overwrite" if overwrite else "errorifexists"
    ordered.write.mode(mode).option("lineSep", LINE_END).text(path)


def read_export(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read the parts back; the row whose cells are the column names is the header."""
    texts = StructType([StructField(name, StringType()) for name in schema.names])
    rows = spark.read.options(**{**FORMAT, "header": False}).schema(texts).csv(path)
    cells = F.array(*[F.col(f"`{c}`") for c in schema.names])
    rows = rows.where(~cells.eqNullSafe(F.array(*map(F.lit, schema.names))))
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
