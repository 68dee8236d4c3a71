"""Column expressions over vectors that are stored as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"\s*-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*"
#: A JSON array of plain numbers. The repeat never gives back, so its depth does not grow with the vector.
VALID = rf"^\[{_NUMBER}(?:,{_NUMBER})*+\]$"


def vector(text: Column) -> Column:
    """The numbers of a JSON array of plain numbers; empty for any other text."""
    values = F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.cast("double"))
    return F.when(text.rlike(VALID), values).otherwise(F.array().cast("array<double>"))


def similarity(a: Column, b: Column) -> Column:
    """The product of two vectors between 0 and 1; 0 if one is empty or the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), product))).otherwise(F.lit(0.0))
