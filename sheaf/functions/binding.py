"""Name a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    Without it, an expression that uses a costly value several times repeats it in the plan, up to
    code too large to compile.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
