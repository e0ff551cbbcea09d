"""Sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flatsql.functions.kernel import Value, is_empty, num, txt


def sort_keys(value: Value, descending: bool) -> list[Column]:
    """A typed column sorts by itself; a text column as empty, numbers by value, other text by bytes."""
    turn = lambda c: c.desc() if descending else c.asc()
    if value.kind != "text":
        return [turn(value.column)]
    number = num(value)
    rank = F.when(is_empty(value), 0).when(number.isNotNull(), 1).otherwise(2)
    return [turn(rank), turn(number), turn(txt(value))]
