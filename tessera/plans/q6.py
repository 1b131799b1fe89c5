"""TPC-H Query 6 in its variants."""

from __future__ import annotations

from tessera.operators.filter_sum import RevenueWindow, revenue
from tessera.session import table


def _query(window: RevenueWindow, variant: str):
    return lambda spark, sf_dir: revenue(table(spark, sf_dir, "lineitem"), window, variant)


def _sql(first: str, last: str) -> str:
    return f"""
        SELECT CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)), 0)
               AS BIGINT) AS revenue
        FROM lineitem
        WHERE l_shipdate >= {first} AND l_shipdate < {last}
          AND CAST(round(l_discount * 100) AS BIGINT) BETWEEN 5 AND 7 AND l_quantity < 24"""


_YEAR = RevenueWindow.year(1996)
_DAYS = RevenueWindow.day_numbers(1462, 1827)
_NONE = RevenueWindow.year(1994)
_DAYS_LITERAL = RevenueWindow.day_numbers(732, 1097)

QUERIES = {
    "q6_branching": _query(_YEAR, "branching"),
    "q6_predication": _query(_YEAR, "predication"),
    "q6_daynum": _query(_DAYS, "branching"),
    "q6_daynum_literal": _query(_DAYS_LITERAL, "predication"),
    "q6_empty_window": _query(_NONE, "branching"),
}
_Y = _sql("TIMESTAMP '1996-01-01'", "TIMESTAMP '1997-01-01'")
ORACLES = {
    "q6_branching": _Y,
    "q6_predication": _Y,
    "q6_daynum": _sql("DATE '1992-01-01' + 1462", "DATE '1992-01-01' + 1827"),
    "q6_daynum_literal": _sql("DATE '1992-01-01' + 732", "DATE '1992-01-01' + 1097"),
    "q6_empty_window": _sql("TIMESTAMP '1994-01-01'", "TIMESTAMP '1995-01-01'"),
}
