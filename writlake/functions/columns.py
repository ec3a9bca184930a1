"""The scalar operators as Spark Columns: ``columns.normalize("text")``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from writlake.functions import expressions
from writlake.functions.dialect import SPARK


def __getattr__(name: str):
    operator = getattr(expressions, name)

    def column(*columns: str) -> Column:
        return F.expr(operator(SPARK, *columns))

    column.__doc__ = operator.__doc__
    return column
