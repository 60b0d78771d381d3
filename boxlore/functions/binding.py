"""A value that an expression uses many times, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value. Written out, each use in a branch would compute the value again; a lambda's variable is a slot."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)
