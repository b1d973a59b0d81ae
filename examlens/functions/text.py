"""Label helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A label has the form "[code] NAME"; longer ones than 65
# characters are shown as their first 61 and three dots.
LABEL_CODE = r"^\[([^\]]+)\]"
LABEL_LIMIT = 65
LABEL_KEPT = 61


def label_code(label: Column) -> Column:
    """The code a label starts with, '' if there is none."""
    return F.regexp_extract(label, LABEL_CODE, 1)


def short_label(label: Column) -> Column:
    return F.when(
        F.char_length(label) > LABEL_LIMIT,
        F.concat(F.substring(label, 1, LABEL_KEPT), F.lit("...")),
    ).otherwise(label)


def decimal_comma(number: Column) -> Column:
    """A plain number as text with a decimal comma, whole numbers without fraction."""
    return F.translate(F.regexp_replace(number.cast("string"), r"\.0$", ""), ".", ",")
