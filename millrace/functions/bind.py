"""Naming of an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with *value* computed once a row. Without it a value that is used in the branches of a CASE or inside
    a lambda is computed again at every use, since common subexpressions are not shared there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
