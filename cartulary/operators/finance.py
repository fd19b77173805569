"""Derived finance measures as column expressions; a ratio over nothing is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def net_position(assets: Column | str, liabilities: Column | str) -> Column:
    return _col(assets) - _col(liabilities)


def debt_ratio(liabilities: Column | str, assets: Column | str) -> Column:
    return F.try_divide(_col(liabilities), _col(assets))


def current_ratio(current_assets: Column | str, current_liabilities: Column | str) -> Column:
    return F.try_divide(_col(current_assets), _col(current_liabilities))


def free_cash_flow(revenue: Column | str, *expenses: Column | str) -> Column:
    """Revenue less all expenses; an expense that isn't known counts as none."""
    return reduce(lambda rest, e: rest - F.coalesce(_col(e), F.lit(0.0)), expenses, _col(revenue))


def per_capita(amount: Column | str, population: Column | str) -> Column:
    return F.try_divide(_col(amount), _col(population))
