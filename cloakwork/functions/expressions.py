"""Expression names of several SQL dialects on Spark, for mapping users who bring their own vocabulary.

Most are built in under the same name; this module holds the few that differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(number: Column, places: int = 0) -> Column:
    """Cut towards zero at a decimal place."""
    scaled = number * F.lit(10**places)
    cut = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled))
    return cut / F.lit(10**places)


def decode_value(value: Column, *pairs: object) -> Column:
    """DECODE(x, v1, r1, ..., default); null equals null."""
    out, items = None, list(pairs)
    default = items.pop() if len(items) % 2 else None
    for seen, result in zip(items[::2], items[1::2]):
        test = value.eqNullSafe(F.lit(seen))
        out = F.when(test, F.lit(result)) if out is None else out.when(test, F.lit(result))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def text_of_number(number: Column, places: int) -> Column:
    """TO_CHAR with fixed places and no grouping."""
    return F.round(number.cast("decimal(28,8)"), places).cast(f"decimal(28,{places})").cast("string")


def number_of_text(text: Column) -> Column:
    """TO_NUMBER that gives null for text without a number."""
    return F.trim(text).try_cast("decimal(28,8)")
