"""Money is decimal from the line on, so that sums do not depend on the order of rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount(value: Column) -> Column:
    """A single amount; NULL instead of an error when it does not fit."""
    return value.try_cast("decimal(12,2)")


def line_total(quantity: Column, unit_price: Column) -> Column:
    return amount(quantity * unit_price)


def sales(lines: Column) -> Column:
    """Sum of line totals; NULL instead of an error when it does not fit."""
    return F.sum(lines).try_cast("decimal(18,2)")


def grand_total(sums: Column) -> Column:
    """Sum over a whole table, wide enough for any number of sums."""
    return F.sum(sums).try_cast("decimal(28,2)")
