"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it.

    Predicates are pushed down by copying expressions; an expression that repeats its
    input would multiply at every level.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
