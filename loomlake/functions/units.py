"""Checked arithmetic on unsigned 64-bit counts, held as decimals of 20 digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 2**64 - 1


def count_of(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def checked_add(a: Column, b: Column) -> Column:
    """The sum, or null beyond 2**64 - 1."""
    total = a.cast("decimal(38,0)") + b.cast("decimal(38,0)")
    return F.when(total <= F.lit(str(MOST)).cast("decimal(38,0)"), total.cast("decimal(20,0)"))


def checked_sub(a: Column, b: Column) -> Column:
    """The difference, or null below zero."""
    return F.when(b <= a, (a.cast("decimal(38,0)") - b.cast("decimal(38,0)")).cast("decimal(20,0)"))
