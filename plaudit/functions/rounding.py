"""Rounding of exact integer ratios.

The signal ratios must equal ``round(a / b, 4)`` of IEEE doubles. ``F.round``
rounds the shortest decimal form of the quotient half up, which differs on
ties, so the ratio is rounded in integer arithmetic and only a true decimal
tie looks at the double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**11 + 1: splits a double into a 42-bit head and an 11-bit tail, so that
# either part times 5**4 is exact.
_SPLIT = 2049.0


def rounded_ratio(num: str, den: str, digits: int = 4, wide: bool = False) -> Column:
    """``num / den`` rounded to ``digits`` <= 4 places.

    Both are SQL expressions of BIGINT type, ``num`` >= 0 and ``den`` > 0. For
    totals of many rows ``wide`` takes the products as DECIMAL(38, 0), where
    BIGINT would overflow.
    """
    if wide:
        return _wide_ratio(num, den, digits)
    scale, odd, two = 10**digits, 5**digits, 2 ** (digits + 1)
    num, den = f"cast({num} AS BIGINT)", f"cast({den} AS BIGINT)"
    low = f"({num} * {scale}L div {den})"
    rest = f"({num} * {2 * scale}L - {low} * {den} * 2L)"
    quotient = f"({num} / {den})"
    head = f"({quotient} * {_SPLIT}D - ({quotient} * {_SPLIT}D - {quotient}))"
    excess = f"(({head} * {odd}D - ({low} * 2L + 1L) / {two}D) + ({quotient} - {head}) * {odd}D)"
    up = (
        f"CASE WHEN {rest} > {den} THEN 1L WHEN {rest} < {den} THEN 0L "
        f"WHEN {excess} > 0 THEN 1L WHEN {excess} < 0 THEN 0L ELSE {low} % 2L END"
    )
    return F.expr(f"({low} + {up}) / {scale}D")


def _wide_ratio(num: str, den: str, digits: int) -> Column:
    scale, odd, two = 10**digits, 5**digits, 2 ** (digits + 1)
    num, den = f"cast({num} AS DECIMAL(27, 0))", f"cast({den} AS DECIMAL(27, 0))"
    low = f"({num} * {scale} div {den})"
    rest = f"({num} * {2 * scale} - cast({low} AS DECIMAL(20, 0)) * cast({den} * 2 AS DECIMAL(18, 0)))"
    quotient = f"(cast({num} AS DOUBLE) / cast({den} AS DOUBLE))"
    head = f"({quotient} * {_SPLIT}D - ({quotient} * {_SPLIT}D - {quotient}))"
    excess = f"(({head} * {odd}D - ({low} * 2L + 1L) / {two}D) + ({quotient} - {head}) * {odd}D)"
    up = (
        f"CASE WHEN {rest} > {den} THEN 1L WHEN {rest} < {den} THEN 0L "
        f"WHEN {excess} > 0 THEN 1L WHEN {excess} < 0 THEN 0L ELSE {low} % 2L END"
    )
    return F.expr(f"({low} + {up}) / {scale}D")


def rounded_ratio_sql(num: str, den: str, digits: int = 4) -> str:
    """The same rule as a DuckDB expression over BIGINT expressions."""
    scale, odd, two = 10**digits, 5**digits, 2 ** (digits + 1)
    low = f"(({num}) * {scale} // ({den}))"
    rest = f"(({num}) * {2 * scale} - {low} * ({den}) * 2)"
    quotient = f"(({num})::DOUBLE / ({den})::DOUBLE)"
    head = f"({quotient} * {_SPLIT}::DOUBLE - ({quotient} * {_SPLIT}::DOUBLE - {quotient}))"
    excess = (
        f"(({head} * {float(odd)}::DOUBLE - ({low} * 2 + 1)::DOUBLE / {float(two)}::DOUBLE)"
        f" + ({quotient} - {head}) * {float(odd)}::DOUBLE)"
    )
    return (
        f"(({low} + CASE WHEN {rest} > ({den}) THEN 1 WHEN {rest} < ({den}) THEN 0 "
        f"WHEN {excess} > 0 THEN 1 WHEN {excess} < 0 THEN 0 ELSE {low} % 2 END)::DOUBLE / {float(scale)}::DOUBLE)"
    )
