"""Day, hour and slot keys in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def slot_key(at: Column, prefix: str = "queue:") -> Column:
    return F.concat(F.lit(prefix), F.date_format(F.date_trunc("hour", at), "yyyy-MM-dd'T'HH"))


def hour_floor(at: Column) -> Column:
    return F.date_trunc("hour", at)


def hour_after(at: Column) -> Column:
    return F.date_trunc("hour", at) + F.expr("INTERVAL 1 HOUR")


def is_posting_hour(at: Column, first: int = 0, last: int = 17) -> Column:
    return F.hour(at).between(first, last)


def shifted_hour(hour: Column, offset: int) -> Column:
    """Hour of the day in a zone of fixed offset."""
    return F.pmod(hour + offset, F.lit(24))


def next_even_hour(at: Column) -> Column:
    """The next full even UTC hour."""
    up = hour_after(at)
    return F.when(F.hour(up) % 2 == 0, up).otherwise(up + F.expr("INTERVAL 1 HOUR"))
