"""Rounding that doesn't depend on the order in which a sum was added up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Puts the boundary between neighbours where means of short decimals never fall.
SHIFT = 0.31830988


def settle(x: Column, digits: int = 6) -> Column:
    return F.floor(x * 10.0**digits + SHIFT) / 10.0**digits


def settle_sql(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * {10.0**digits!r} + {SHIFT}) / {10.0**digits!r}"
