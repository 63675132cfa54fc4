"""Exact money arithmetic on decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOTAL = "decimal(38,2)"


def amount(quantity: str = "quantity_sold", price: str = "selling_price") -> Column:
    """Line value: quantity times unit price."""
    return (F.col(quantity).cast("decimal(18,0)") * F.col(price)).cast("decimal(28,2)")


def total(column: Column | str) -> Column:
    """Sum of money, 0 over no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast(TOTAL)


def units(column: Column | str) -> Column:
    """Sum of units, 0 over no rows."""
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def ratio(above: Column, below: Column) -> Column:
    """Quotient as DOUBLE, 0 when the divisor is 0 or missing."""
    safe = F.when(below != 0, below.cast("double"))
    return F.coalesce(above.cast("double") / safe, F.lit(0.0))


def money_text(column: Column | str) -> Column:
    """Display form: currency sign and two decimals."""
    col = F.col(column) if isinstance(column, str) else column
    return F.concat(F.lit("₹"), col.cast("decimal(38,2)").cast("string"))
